"""Declarations, imports and calls of languages with braces, and of Ruby, found in text whose comments and strings are blanked.

Blanking keeps every offset, so names are looked for in the blanked text and origins of imports read from the real one. Spans nest by their
brackets (Ruby: by ``end``), which gives scopes, classes of functions and the innermost function of a call. Each file is one pass of its own
length; a table of files is dealt out by Spark (``parse.parsed``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Strings and comments by family of languages.
SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
DOUBLE, SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
QUIET = {
    "typescript": rf"{SLASHES}|{DOUBLE}|{SINGLE}|`(?:\\.|[^`\\])*`",
    "java": rf'{SLASHES}|""".*?"""|{DOUBLE}|{SINGLE}',
    "csharp": rf'{SLASHES}|@"(?:""|[^"])*"|{DOUBLE}|{SINGLE}',
    "php": rf'{SLASHES}|#(?!\[)[^\n]*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'',
    "rust": rf"{SLASHES}|{DOUBLE}|'(?:\\[^'\n]+|[^'\\\n])'",
    "ruby": rf"^=begin.*?^=end|#[^\n]*|{DOUBLE}|{SINGLE}",
}
QUIET["javascript"] = QUIET["typescript"]
CLASSES = {"class", "struct", "record", "impl", "module"}
SELF = {"this", "self", "$this"}
# Words before a bracket that are no calls, and words before a name that are no types.
NO_CALLS = frozenset("if for foreach while switch catch return function fn new super match using lock sizeof typeof elseif until unless when and or not in yield await throw case else constructor async base delegate".split())
MODIFIERS = frozenset("public private protected internal static async final override virtual abstract readonly sealed partial extern unsafe synchronized native default export declare get set const var volatile transient required".split())
SEPARATOR = re.compile(r"\s*(?:\?\.|\.|\?->|->|::|&\.)\s*")
TYPE = re.compile(r"(?<![.\w$@])(class|interface|enum|struct|trait|record|impl)\b(?:\s+(?=\w)|\s*<)([^{};]*)")
ALIAS = re.compile(r"(?<![.\w$])type\s+(\w+)\s*(?:<[^=]*>)?\s*=\s*")
NAMED = re.compile(r"\b(?:function\s*\*?|fn)\s+&?(\w+)\s*(?:<[^>(]*>)?\s*\(|(?:\b(?:const|let|var)\s+|\$)(\w+)\s*(?::[^=;(]+)?=\s*(?:static\s+)?(?:async\s*)?(?:function\b|fn\b)?\s*\(|\b(\w+)\s*=\s*(?:delegate\b\s*)?\(")
METHOD = re.compile(r"(?<![@\w.$>])(\w+)\s*(?:<[^<>()]*>)?\s*\(")
AFTER = re.compile(r"\s*(?:(?:->|:)\s*(?P<type>(?!base\b|this\b)[^{};=]+?))?\s*(?:(?:throws|where)\b[^{;]*|:\s*(?:base|this)\s*\([^)]*\)\s*)?(?P<end>\{|;|=>|->)")
IMPORTS = {
    "typescript": re.compile(r"""\bimport\s+(?:type\s+)?(?:(?P<default>\w+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}|\*\s+as\s+(?P<whole>\w+))?\s*(?:from\s*)?(?P<quote>["'])|\b(?:const|let|var)\s+(?:\{(?P<names2>[^}]*)\}|(?P<whole2>\w+))\s*=\s*require\s*\(\s*(?P<quote2>["'])"""),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<path>[\w.]+?)(?:\.(?P<star>\*))?\s*;", re.M),
    "csharp": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;", re.M),
    "php": re.compile(r"""^\s*use\s+(?:function\s+|const\s+)?(?P<path>[\w\\]+?)(?:\\\{(?P<names>[^}]*)\}|\s+as\s+(?P<alias>\w+))?\s*;|\b(?:require|include)(?:_once)?\s*\(?\s*(?P<quote>["'])""", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+(?P<path>[\w:]+?)(?:::\{(?P<names>[^}]*)\}|::(?P<star>\*)|\s+as\s+(?P<alias>\w+))?\s*;", re.M),
    "ruby": re.compile(r"""^\s*(?:require|require_relative|load)\s*\(?\s*(?P<quote>["'])""", re.M),
}
IMPORTS["javascript"] = IMPORTS["typescript"]
PROPERTY = {
    "typescript": re.compile(r"(?:^|(?<=[;{}]))[ \t]*(?:@\w+\s*(?:\(\s*\))?\s*)?(?:(?:public|private|protected|readonly|static|declare|abstract)\s+)*#?(\w+)[?!]?\s*(?::\s*([^=;\n{]+))?\s*(?=[=;]|$)", re.M),
    "java": re.compile(r"(?:^|(?<=[;{}]))[ \t]*(?:(?:public|private|protected|internal|static|final|readonly|volatile|transient|required|const)\s+)*(?P<type>[A-Za-z_][\w.<>\[\]?, ]*?)\s+(?P<name>\w+)\s*(?=[=;{])", re.M),
    "php": re.compile(r"(?:^|(?<=[;{}]))[ \t]*(?:(?:public|private|protected|static|readonly|var)\s+)+(?P<type>[?\w\\|]+\s+)?\$(?P<name>\w+)", re.M),
    "rust": re.compile(r"(?:^|(?<=[,{]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^,\n]+)", re.M),
}
PROPERTY |= {"javascript": PROPERTY["typescript"], "csharp": PROPERTY["java"]}
MEMBER = re.compile(r"(?:^|,)\s*(?:case\s+)?(\w+)\s*(?=[,=;({]|$)", re.M)


@dataclass
class Span:
    """A declaration: where it starts and ends, its kind, and what was read from its head."""

    start: int
    end: int
    kind: str
    name: str
    at: int
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    params: list[str] = field(default_factory=list)
    returns: str = ""
    fields: dict[str, str] = field(default_factory=dict)


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def blank(lang: str, text: str) -> str:
    """``text`` without comments and insides of strings; every offset and line stays."""

    def quiet(m: re.Match) -> str:
        s = m[0]
        quotes = s[0] in "\"'`" and len(s) > 1
        return s[0] + _spaces(s[1:-1]) + s[-1] if quotes else _spaces(s)

    return re.sub(QUIET[lang], quiet, text, flags=re.S | re.M)


def pairs(text: str) -> dict[int, int]:
    """Offsets of brackets that belong together, in both directions; brackets without a partner are left out."""
    found, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        c, i = m[0], m.start()
        if c in "([{":
            open_.append((c, i))
        elif open_ and open_[-1][0] == "([{"[")]}".index(c)]:
            j = open_.pop()[1]
            found[i], found[j] = j, i
    return found


def parts(text: str) -> list[str]:
    """Pieces between the commas that no bracket holds."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"[(\[{<]|(?<![-=])>|[)\]}]|,", text):
        if m[0] == ",":
            if depth == 0:
                out.append(text[last : m.start()])
                last = m.end()
        else:
            depth += 1 if m[0] in "([{<" else -1
    return [p for p in (" ".join(x.split()) for x in [*out, text[last:]]) if p]


def _head(kind: str, lang: str, head: str) -> tuple[str, list[str], list[str]]:
    """Name, extended and implemented names of a type's head."""
    names = lambda found: [x for x in (re.sub(r"[<(].*", "", p, flags=re.S).strip() for p in parts(found or "")) if x]
    if kind == "impl":
        m = re.match(r"(?:[\w\s:,+']*>\s*)?(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?([\w:]+)", head)
        return (m[2].split("::")[-1], [], [m[1]] if m[1] else []) if m else ("", [], [])
    m = re.match(r"(?:class\s+|struct\s+)?(\w+)", head)
    if not m:
        return "", [], []
    rest = re.sub(r"\bwhere\b.*", "", head[m.end() :], flags=re.S)
    extends = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", rest, re.S)
    implements = re.search(r"\bimplements\s+(.*?)(?=\bpermits\b|$)", rest, re.S)
    bases = re.search(r"(?<!:):(?!:)\s*(.*)", re.sub(r"\([^)]*\)", "", rest), re.S) if lang in ("csharp", "rust") else None
    return m[1], names(extends and extends[1]) + [b for x in names(bases and bases[1]) for b in x.split("+") if b.strip()], names(implements and implements[1])


def _before(text: str, at: int) -> str:
    """The statement's words before ``at``."""
    return text[max(text.rfind(c, 0, at) for c in ";{}") + 1 : at]


def _returns(lang: str, before: str, after: str | None) -> str:
    if lang in ("java", "csharp"):
        words = [w for w in re.sub(r"@\w+(\([^)]*\))?|\[[A-Z]\w*\]", " ", before).split() if w not in MODIFIERS]
        return " ".join(words)
    return " ".join((after or "").split())


def _braces(lang: str, text: str, quiet: str, match: dict[int, int]) -> list[Span]:
    spans, named = [], set()
    for m in TYPE.finditer(quiet):
        name, extends, implements = _head(m[1], lang, m[2])
        stop = quiet[m.end() : m.end() + 1]
        if name and stop in ("{", ";"):
            spans.append(Span(m.start(), match.get(m.end(), len(quiet)) if stop == "{" else m.end(), m[1], name, m.start(), extends, implements))
    for m in ALIAS.finditer(quiet):
        stop = quiet.find(";", m.end())
        if quiet[m.end() : m.end() + 1] == "{":
            stop = match.get(m.end(), len(quiet))
        end = stop if stop >= 0 else len(quiet)
        fields = {k: " ".join(v.split()) for k, v in re.findall(r"(\w+)\??\s*:\s*([^;,\n}]+)", quiet[m.end() : end])}
        spans.append(Span(m.start(), end, "alias", m[1], m.start(), fields=fields or {m[1]: " ".join(text[m.end() : end].split())}))

    def add(name: str, at: int, start: int, bracket: int, signature: bool) -> int | None:
        close = match.get(bracket)
        after = AFTER.match(quiet, close + 1) if close else None
        if not after or (after["end"] == ";" and not signature) or bracket in named:
            return None
        end = after.end("end")
        if after["end"] != ";":
            brace = re.compile(r"\s*(\{)").match(quiet, after.end("end")) if after["end"] != "{" else None
            at_brace = after.start("end") if after["end"] == "{" else brace.start(1) if brace else None
            line = quiet.find(";", end)
            end = match.get(at_brace, len(quiet)) if at_brace is not None else (line if line >= 0 else len(quiet))
        named.add(bracket)
        spans.append(Span(start, end, "function", name, at, params=parts(text[bracket + 1 : close]), returns=_returns(lang, _before(quiet, at), after["type"])))
        return end

    for m in NAMED.finditer(quiet):
        group = next(g for g in (1, 2, 3) if m[g])
        arrow = group > 1
        close = match.get(m.end() - 1)
        if arrow and (not close or not re.match(r"\s*(?:\{|(?::[^;{}=]*)?=>|->)", quiet[close + 1 : close + 200])):
            continue
        add(m[group], m.start(group), m.start(group) if group == 3 else m.start(), m.end() - 1, signature=lang == "rust" or lang == "php")
    for t in [s for s in spans if s.kind not in ("function", "alias")]:
        body = quiet.find("{", t.start, t.end + 1)
        if body < 0:
            continue
        flat = flatten(quiet, body, t.end, match)
        if lang != "rust":
            at = body + 1
            while m := METHOD.search(flat, at, t.end):
                at = m.end()
                before = _before(flat, m.start())
                if m[1] in NO_CALLS - {"constructor"} or "=" in before or before.split()[-1:] in (["new"], ["function"], ["fn"], ["record"]) or (t.kind == "enum" and not before.strip() and quiet[match.get(m.end() - 1, 0) + 1 :].lstrip()[:1] in (";", ",")):
                    continue
                stop = add(m[1], m.start(), m.start() - len(before.lstrip()), m.end() - 1, signature=True)
                at = stop or match.get(m.end() - 1, at)
        _fields(lang, t, spans, flat, body)
    return spans


def flatten(quiet: str, body: int, end: int, match: dict[int, int]) -> str:
    """``quiet`` up to ``end`` with everything in the brackets inside the body blanked; brackets stay."""
    out, at = [" " * body + "{"], body + 1
    for m in re.finditer(r"\{", quiet[body + 1 : end]):
        i = body + 1 + m.start()
        if i >= at:
            j = match.get(i, end)
            out += [quiet[at : i + 1], _spaces(quiet[i + 1 : j])]
            at = j
    return "".join([*out, quiet[at:end]])


def _fields(lang: str, t: Span, spans: list[Span], flat: str, body: int) -> None:
    """Methods as ``(p1, p2):type``, properties by their type."""
    rest = flat
    for s in spans:
        if s.kind == "function" and t.start < s.start and s.end <= t.end and flat.find(s.name, s.at, s.at + len(s.name)) == s.at:
            t.fields[s.name] = f"({', '.join(s.params)}):{s.returns or 'unknown'}"
            rest = rest[: s.start] + _spaces(rest[s.start : s.end + 1]) + rest[s.end + 1 :]
    if t.kind == "enum":
        for m in MEMBER.finditer(rest[body + 1 :].split(";")[0]):
            t.fields.setdefault(m[1], t.name)
        return
    for m in PROPERTY[lang].finditer(rest, body + 1):
        name, kind = (m["name"], m["type"]) if "name" in m.re.groupindex else (m[1], m[2])
        if name not in MODIFIERS and name not in NO_CALLS and (kind or "").split()[:1] not in (["return"], ["package"]):
            t.fields.setdefault(name, " ".join((kind or "").split()) or "unknown")


RUBY = re.compile(r"(?P<open>(?:^|;|=|\bthen\b|\belse\b)[ \t]*(?:if|unless|while|until|case|begin|for)\b|\bdo\b)|^[ \t]*(?P<kind>class|module|def)[ \t]+(?:<<[ \t]*)?(?:self\.)?(?P<name>[\w:]+[?!=]?)(?P<rest>[^\n;]*)|(?<![.\w:@])(?P<end>end)\b(?![?!:])", re.M)
RUBY_LAMBDA = re.compile(r"^[ \t]*(\w+)[ \t]*=[ \t]*(?:->|lambda\b|proc\b)[ \t]*(?:\(([^)]*)\))?", re.M)


def _ruby(lang: str, text: str, quiet: str, match: dict[int, int]) -> list[Span]:
    spans, open_ = [], []
    loop = -1
    for m in RUBY.finditer(quiet):
        if m["open"]:
            # ``while ... do`` has one end for both words.
            if m["open"].strip() == "do" and loop >= 0 and "\n" not in quiet[loop : m.start()]:
                loop = -1
                continue
            loop = m.start() if re.search(r"while|until|for", m["open"]) else -1
            open_.append(None)
        elif m["kind"]:
            rest = m["rest"]
            base = re.match(r"\s*<\s*([\w:]+)", rest)
            params = re.match(r"\s*\(([^)]*)\)|\s+([^=\n]+)$", rest)
            span = Span(m.start("kind"), len(quiet), "function" if m["kind"] == "def" else m["kind"], m["name"].split("::")[-1], m.start("name"), extends=[base[1]] if base and m["kind"] == "class" else [])
            if m["kind"] == "def":
                span.params = parts((params[1] or params[2] or "") if params else "")
            spans.append(span)
            if m["kind"] == "def" and re.match(r"\s*(?:\([^)]*\))?\s*=(?!=)", rest):
                span.end = m.end()
            else:
                open_.append(span)
        elif open_:
            span = open_.pop()
            if span:
                span.end = m.end()
    for m in RUBY_LAMBDA.finditer(quiet):
        brace = re.compile(r"[ \t]*\{").match(quiet, m.end())
        stop = match.get(brace.end() - 1, m.end()) if brace else m.end()
        spans.append(Span(m.start(1), stop, "function", m[1], m.start(1), params=parts(m[2] or "")))
    spans.sort(key=lambda s: s.start)
    for t in spans:
        if t.kind == "function":
            continue
        for m in re.finditer(r"^[ \t]*(include|extend|prepend)[ \t(]+([\w:, ]+)|^[ \t]*(attr\w*)[ \t(]+([^\n)]+)", quiet[t.start : t.end], re.M):
            inner = [s for s in spans if s.kind != "function" and s.start <= t.start + m.start(1 if m[1] else 3) < s.end][-1]
            if inner is t and m[1]:
                t.extends += parts(m[2])
            elif inner is t:
                t.fields |= {p.lstrip(":"): "unknown" for p in parts(m[4])}
        for s in spans:
            if s.kind == "function" and t.start < s.start < t.end and not any(o.start < s.start < o.end and o.start > t.start for o in spans if o is not s):
                t.fields[s.name] = f"({', '.join(s.params)}):unknown"
    return spans


def _imports(lang: str, text: str, quiet: str) -> list[tuple[int, str, str, str | None]]:
    """Offset, origin, symbol and alias; without a symbol, or with a lone alias, the symbol is ``*``."""
    out = []
    for m in IMPORTS[lang].finditer(quiet):
        g = m.groupdict()
        quote = next((k for k in ("quote", "quote2") if g.get(k)), None)
        origin = g.get("path")
        if quote:
            stop = quiet.find(g[quote], m.end())
            origin = text[m.end() : stop] if stop >= 0 else ""
        if not origin:
            continue
        found = [("*", g["default"])] if g.get("default") else []
        for p in parts(g.get("names") or g.get("names2") or ""):
            name, _, alias = re.sub(r"^type\s+", "", p).replace(":", " as ", 1 if lang in ("typescript", "javascript") else 0).partition(" as ")
            found.append((name.strip(), alias.strip() or None))
        whole = g.get("whole") or g.get("whole2") or g.get("alias")
        if whole or not found:
            found.append(("*", whole))
        out += [(m.start(), origin, name, alias) for name, alias in found]
    return out


def _chain(quiet: str, at: int, match: dict[int, int]) -> list[str]:
    """Links before the name at ``at``, outermost first."""
    links: list[str] = []
    while m := re.search(r"(?:\?\.|\.|\?->|->|::|&\.)\s*$", quiet[max(0, at - 200) : at]):
        i = max(0, at - 200) + m.start()
        i = len(quiet[:i].rstrip()) if quiet[i - 1 : i].isspace() else i
        while quiet[i - 1 : i] in (")", "]") and (i - 1) in match:
            i = match[i - 1]
        w = re.search(r"\$?\w+[!?]?$", quiet[max(0, i - 100) : i])
        if not w:
            break
        at = i - len(w[0])
        links.insert(0, w[0])
    return links


def _calls(lang: str, quiet: str, match: dict[int, int], spans: list[Span]) -> list[tuple[int, str, list[str]]]:
    declared = {s.at for s in spans}
    name = re.compile(r"(?<![\w$@#])([A-Za-z_]\w*)([!?]?)\s*(?:<[\w\s,.<>\[\]]*>)?\s*\(" + (r"|(?<=[\w)\]])(?:\.|&\.)([a-z_]\w*)[?!]?" if lang == "ruby" else ""))
    out = []
    for m in name.finditer(quiet):
        group = 1 if m[1] else 3
        at, word = m.start(group), m[group]
        if at in declared or word in NO_CALLS or re.search(r"\bnew\s+(?:[\w\\.]+[.\\])?$", quiet[max(0, at - 80) : at]):
            continue
        end = match.get(m.end() - 1, m.end()) + 1 if quiet[m.end() - 1] == "(" else m.end()
        follows = SEPARATOR.match(quiet, end)
        if follows and re.match(r"[A-Za-z_$]", quiet[follows.end() : follows.end() + 1]):
            continue
        out.append((at, word, _chain(quiet, at, match)))
    return out


def _injected(lang: str, params: list[str]) -> dict[str, str]:
    """Names of a constructor's parameters with their types."""
    out = {}
    for p in params:
        p = re.sub(r"=.*", "", p).strip()
        if lang in ("typescript", "javascript", "rust"):
            name, _, kind = p.partition(":")
            name = name.split()[-1].rstrip("?") if name.split() else ""
        else:
            kind, _, name = p.rpartition(" ")
            kind = kind.split()[-1] if kind.split() else ""
            name = name.lstrip("$")
        kind = re.sub(r"<.*", "", kind).strip().lstrip("?")
        if name and kind:
            out[name] = kind
    return out


def read(lang: str, text: str, constructor: str) -> list[dict]:
    """Rows (kind, name, scope, class_name, ...) of one text in order: imports, types, functions, calls. ``owner`` of a call is its function's place in the list."""
    quiet = blank(lang, text)
    match = pairs(quiet)
    spans = sorted((_ruby if lang == "ruby" else _braces)(lang, text, quiet, match), key=lambda s: (s.start, -s.end))
    lines = [m.start() for m in re.finditer("\n", text)]
    line = lambda i: bisect_right(lines, i - 1) + 1
    rows = [{"kind": "import", "name": symbol, "origin": origin, "alias": alias, "scope": []} for _, origin, symbol, alias in _imports(lang, text, quiet)]

    # Scopes by a sweep: spans nest, so the open ones are a stack.
    above: list[list[Span]] = []
    open_: list[Span] = []
    for s in spans:
        while open_ and open_[-1].end < s.start:
            open_.pop()
        above.append(list(open_))
        if s.kind != "alias":
            open_.append(s)

    def owner_class(chain: list[Span]) -> str:
        types = [s for s in reversed(chain) if s.kind != "function"]
        return next((s.name for s in types if s.kind in CLASSES), types[0].name if types else "")

    KIND = {"interface": "INTERFACE", "trait": "INTERFACE", "enum": "ENUM", "alias": "TYPE_ALIAS"}
    for wanted in (("alias",), ("class", "struct", "record", "impl", "module", "interface", "trait", "enum")):
        for s, chain in zip(spans, above, strict=True):
            if s.kind in wanted:
                rows.append({"kind": "type", "type_kind": KIND.get(s.kind, "CLASS"), "name": s.name, "scope": [x.name for x in chain], "extends": s.extends, "implements": s.implements, "fields": s.fields, "start_line": line(s.start), "end_line": line(s.end)})
    at_row, injected = {}, {}
    for n, (s, chain) in enumerate(zip(spans, above, strict=True)):
        if s.kind == "function":
            owner = owner_class(chain)
            at_row[n] = len(rows)
            rows.append({"kind": "function", "name": s.name, "scope": [x.name for x in chain], "class_name": owner, "params": s.params, "returns": s.returns, "start_line": line(s.start), "end_line": line(s.end)})
            if owner and s.name in (constructor, owner):
                injected[owner] = _injected(lang, s.params)
    events, n = [], 0
    open_numbers: list[int] = []
    for at, word, chain in _calls(lang, quiet, match, spans):
        while n < len(spans) and spans[n].start <= at:
            while open_numbers and spans[open_numbers[-1]].end < spans[n].start:
                open_numbers.pop()
            open_numbers.append(n)
            n += 1
        while open_numbers and spans[open_numbers[-1]].end < at:
            open_numbers.pop()
        inside = [k for k in open_numbers if spans[k].kind == "function"]
        if inside:
            owner = owner_class([spans[k] for k in open_numbers])
            head = chain[0] if chain else ""
            caller = (chain[1] if len(chain) > 1 else owner) if head in SELF else head.lstrip("$") if lang == "php" else head
            events.append({"kind": "call", "name": word, "owner": at_row[inside[-1]], "caller": injected.get(owner, {}).get(caller, caller), "scope": []})
    return rows + events
