"""Column functions of the code graph, all built in: paths, signatures, tokens, task values, sizing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an error as the system's (in its name or message) or the caller's (in its message).
SYSTEM_ERRORS = ("connection", "timeout", "network", "socket", "dns", "rabbitmq", "s3", "database", "memory", "out of memory", "econnrefused", "enotfound", "etimedout", "econnreset")
BUSINESS_ERRORS = ("repository", "clone", "file not found", "access denied", "authentication", "permission", "not found", "unsupported", "language not supported", "no source files")
# Request keys whose values are not logged.
SENSITIVE_KEYS = ("password", "token", "secret", "key", "authorization")
# Hosts of repositories.
GIT_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
TERMINAL = ("CANCELLED", "COMPLETED", "FAILED")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Paths and references


def normalize_path(path: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(path)), r"\\", "/")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(normalize_path(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(col(path), r"\.[^./]+$", 0))


def reference_path(ref: Column | str) -> Column:
    """``a/b.ts`` of ``a/b.ts::C::m``; a reference without a path stays whole."""
    path = F.regexp_extract(col(ref), r"^(.+\.[a-zA-Z0-9]+)::(.+)$", 1)
    return F.when(path != "", path).otherwise(col(ref))


def reference_symbol(ref: Column | str) -> Column:
    """``C::m`` of ``a/b.ts::C::m``; null without a path."""
    return F.nullif(F.regexp_extract(col(ref), r"^(.+\.[a-zA-Z0-9]+)::(.+)$", 2), F.lit(""))


def scope_path(scope: Column | str) -> Column:
    """Names of an array of (name, type), outermost first."""
    return F.concat_ws("::", F.transform(col(scope), lambda s: s["name"]))


def is_git_url(url: Column | str) -> Column:
    """An http(s) URL at a known host with two path segments, or ``organisation/repository``."""
    u = col(url)
    full = F.regexp_extract(u, r"^https?://([^/?#:@]+)(?::\d+)?(/[^?#]*)?", 1)
    path = F.regexp_extract(u, r"^https?://[^/?#]+(/[^?#]*)?", 1)
    return F.coalesce(F.when(u.rlike("^https?://"), F.lower(full).isin(*GIT_HOSTS) & (F.size(F.split(path, "/")) >= 3)).otherwise(u.rlike("^[^/]+/[^/]+$")), F.lit(False))


def safe_identifier(c: Column | str) -> Column:
    return F.when(col(c).rlike("^[a-zA-Z0-9_-]+$"), col(c)).otherwise(F.substring(F.sha2(col(c), 256), 1, 32))


def sanitize_key(c: Column | str) -> Column:
    safe = F.regexp_replace(col(c), r"[^a-zA-Z0-9._-]", "_")
    return F.substring(F.regexp_replace(F.regexp_replace(safe, r"\.\.", "_"), r"^\.", "_"), 1, 100)


# Code text


def parameter_type(param: Column | str) -> Column:
    """What follows the first colon, trimmed; ``any`` without one."""
    at = F.instr(col(param), ":")
    return F.when(at > 0, F.trim(F.substr(col(param), at + 1))).otherwise(F.lit("any"))


def signature_hash(params: Column | str, returns: Column | str) -> Column:
    """Hash of the return type and the parameters, in any order."""
    sorted_params = F.array_sort(F.transform(col(params), parameter_type))
    return F.sha2(F.concat(F.lit("("), F.array_join(sorted_params, ","), F.lit(")=>"), col(returns)), 256)


def tokens(text: Column | str) -> Column:
    """Distinct words of ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def lines(text: Column | str) -> Column:
    return F.split(col(text), "\n", -1)


def number_lines(text: Column | str, start: Column) -> Column:
    """``start line`` for each line; an empty text gives one numbered empty line."""
    return F.array_join(F.transform(lines(text), lambda x, i: F.concat((start + i).cast("string"), F.lit(" "), x)), "\n")


def number_content(text: Column | str, start: Column) -> Column:
    """``n: line`` without leading blank lines and what follows the last non-blank one; lines keep their numbers."""
    kept = F.filter(F.transform(lines(text), lambda x, i: F.struct((start + i).alias("n"), x.alias("x"))), lambda s: F.trim(s["x"]) != "")
    first, last = F.array_min(F.transform(kept, lambda s: s["n"])), F.array_max(F.transform(kept, lambda s: s["n"]))
    numbered = F.transform(lines(text), lambda x, i: F.struct((start + i).alias("n"), x.alias("x")))
    inside = F.filter(numbered, lambda s: s["n"].between(first, last))
    return F.array_join(F.transform(inside, lambda s: F.trim(F.concat(s["n"].cast("string"), F.lit(": "), s["x"]))), "\n")


def strip_numbering(diff: Column | str, trim: bool = False) -> Column:
    """A numbered diff as a plain one; hunk marks and blank lines become empty. ``trim`` also trims all other lines."""

    def clean(x: Column) -> Column:
        t = F.regexp_replace(x, r"^\s+|\s+$", "")
        numbered = F.regexp_extract(F.regexp_replace(x, r"^\s+", ""), r"^\d+\s+([+\- ].*)$", 1)
        other = t if trim else x
        return F.when(t.isin("", "__new hunk__", "__old hunk__"), F.lit("")).when(numbered != "", numbered).otherwise(other)

    return F.array_join(F.transform(F.split(col(diff), "\r?\n", -1), clean), "\n")


def row_of(text: Column | str, index: Column) -> Column:
    """0-based line of a 0-based character index."""
    return F.size(F.split(F.substr(col(text), F.lit(1), index), "\n", -1)) - 1


def column_of(text: Column | str, index: Column) -> Column:
    """0-based column of a 0-based character index in its line."""
    return F.length(F.element_at(F.split(F.substr(col(text), F.lit(1), index), "\n", -1), -1))


def path_parts(path: Column) -> Column:
    """Parts of a POSIX path, without empty ones and ``.``; ``..`` takes back the part before it."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))


def relative_path(base: Column, path: Column) -> Column:
    """``path`` as seen from the folder ``base``; empty if they are the same."""
    a, b = path_parts(base), path_parts(path)
    least = F.least(F.size(a), F.size(b))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= least) & (F.try_element_at(a, i) == F.try_element_at(b, i)), i).otherwise(k))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


def encoded(text: Column | str) -> Column:
    """Base64 of the UTF-8 bytes, in one line."""
    return F.regexp_replace(F.base64(F.encode(col(text), "UTF-8")), r"\s", "")


def words_of_code(text: Column | str) -> Column:
    """Every run of letters, digits, ``_`` and ``$``, in order, repeats included."""
    return F.regexp_extract_all(col(text), F.lit(r"[\w$]+"), F.lit(0))


def partial_match(record: Column, wanted: dict) -> Column:
    """Whether a struct holds all of ``wanted``, nested dicts field by field; a null or missing value never matches."""
    found = F.lit(True)
    for name, value in wanted.items():
        inner = record[name]
        found = found & F.coalesce(partial_match(inner, value) if isinstance(value, dict) else inner == F.lit(value), F.lit(False))
    return found


def deep_merge(old: Column, new: Column) -> Column:
    """Maps merged, the newer value of a key holds; a null map changes nothing."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def tagged_json(value: Column, kind: str) -> Column:
    """A map (kind ``Map``) or array (kind ``Set``) as JSON that names its kind."""
    body = F.transform(F.map_entries(value), lambda e: F.array(e["key"].cast("string"), e["value"].cast("string"))) if kind == "Map" else F.array_distinct(value)
    return F.to_json(F.struct(F.lit(kind).alias("__type"), body.alias("value")))


def untagged_map(text: Column | str) -> Column:
    """The map of a tagged JSON text; null for other kinds."""
    entries = F.from_json(col(text), "__type string, value array<array<string>>")
    return F.when(entries["__type"] == "Map", F.map_from_entries(F.transform(entries["value"], lambda e: F.struct(e[0], e[1]))))


# Tasks and errors


def clamp_progress(c: Column | str) -> Column:
    return F.when(col(c).isNotNull() & ~F.isnan(col(c).cast("double")), F.greatest(F.lit(0), F.least(F.lit(100), col(c))))


def stored_status(c: Column | str) -> Column:
    """Text of a status as stored; unknown ones are pending."""
    known = ("PENDING", "IN_PROGRESS", *TERMINAL)
    return F.when(col(c).isin(*known), col(c)).otherwise(F.lit("PENDING"))


def read_status(c: Column | str) -> Column:
    """Status of a stored text; unknown ones are unspecified."""
    known = ("PENDING", "IN_PROGRESS", *TERMINAL)
    return F.when(col(c).isin(*known), col(c)).otherwise(F.lit("UNSPECIFIED"))


def priority(c: Column | str) -> Column:
    return F.when(col(c).isin(1, 2, 3), col(c)).otherwise(F.lit(2))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def error_class(name: Column, message: Column, explicit: Column | None = None) -> Column:
    name, message = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    guess = F.when(contains_any(name, SYSTEM_ERRORS) | contains_any(message, SYSTEM_ERRORS), F.lit("SYSTEM_ERROR")).when(contains_any(message, BUSINESS_ERRORS), F.lit("BUSINESS_ERROR")).otherwise(F.lit("SYSTEM_ERROR"))
    return guess if explicit is None else F.coalesce(explicit, guess)


def routing_key(kind: Column | str, routes: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in routes.items() for x in pair)) if routes else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, col(kind)), F.concat(F.lit("ast.custom."), F.lower(col(kind))))


def redact(body: Column | str) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(col(body), lambda k, v: F.when(k.isin(*SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(v))


def diagnostic_signature(source: Column | str, code: Column | str, message: Column | str) -> Column:
    return F.concat_ws("::", *(F.coalesce(col(c), F.lit("")) for c in (source, code, message)))


def timestamp_seconds(ts: Column | str) -> Column:
    return F.coalesce(F.floor(F.unix_micros(col(ts).cast("timestamp")) / 1_000_000), F.lit(0)).cast("long")


def timestamp_nanos(ts: Column | str) -> Column:
    """Nanoseconds of whole milliseconds."""
    return F.coalesce(F.pmod(F.floor(F.unix_micros(col(ts).cast("timestamp")) / 1000), F.lit(1000)) * 1_000_000, F.lit(0)).cast("long")


# Sizing rules; the numbers are fixed values.


def backoff_ms(attempt: Column | str) -> Column:
    return F.least(F.lit(1000) * F.pow(F.lit(2), col(attempt)), F.lit(10_000)).cast("long")


def adaptive_timeout_ms(files: Column, mean_bytes: Column, large_share: Column) -> Column:
    size = F.when(files > 100, 2.5).when(files > 50, 2.0).when(files > 20, 1.5).otherwise(1.0)
    complexity = F.when((mean_bytes > 100_000) | (large_share > 0.5), 1.8).when((mean_bytes > 50_000) | (large_share > 0.3), 1.4).otherwise(1.0)
    return F.least(F.lit(300_000), F.greatest(F.lit(30_000), F.round(F.lit(60_000.0) * size * complexity))).cast("long")


def batch_size(cpus: Column, files: Column, heap_share: Column) -> Column:
    base = F.greatest(F.lit(20), F.least(cpus * 8, F.lit(100)))
    base = F.when(files > 20_000, F.least(base, F.lit(30))).when(files > 10_000, F.least(base, F.lit(40))).when(files > 5_000, F.least(base, F.lit(50))).otherwise(base)
    return F.when(heap_share > 0.8, F.greatest(F.lit(5), F.floor(base * 0.6))).when(heap_share > 0.6, F.greatest(F.lit(8), F.floor(base * 0.8))).otherwise(base).cast("long")


def upload_timeout_ms(size_bytes: Column) -> Column:
    return F.least(F.lit(300_000), F.floor(30_000 * F.greatest(F.lit(1.0), F.ceil(size_bytes / 1_048_576) / 10))).cast("long")
