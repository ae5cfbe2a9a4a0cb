"""Building the typed property graph: lookups with explicit order, dedup, edges in both directions, ownership.

"First wins" and "last wins" are row_number over an explicit ``ordinal``; a snapshot table carries it from the parser on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.scalar import normalize_path
from spandrel.operators.storage import written

INVERSE = {"IMPLEMENTS": "IMPLEMENTED_BY", "EXTENDS": "EXTENDED_BY"}


def first_by(df: DataFrame, keys: list[str], *order: str, last: bool = False) -> DataFrame:
    """One row per key: the first in ``order``, or the last."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    return first_by(nodes, ["id"], "ordinal")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (src, dst, type); it keeps its paths."""
    return first_by(edges, ["src", "dst", "type"], "ordinal")


def defined_once(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key and the sorted distinct names (classes, functions, imports) that each file defines; nulls are no names."""
    return rows.where(F.col(name).isNotNull()).select(key, name).distinct().groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"))


def existing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("_id"))
    return edges.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")


def with_inverse(edges: DataFrame) -> DataFrame:
    """Inheritance edges in both directions."""
    kinds = F.create_map(*(F.lit(x) for p in INVERSE.items() for x in p))
    edge = lambda src, dst, type_: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), type_.alias("type"))
    there, back = edge("src", "dst", F.col("type")), edge("dst", "src", F.try_element_at(kinds, F.col("type")))
    return edges.select(F.explode(F.when(F.col("type").isin(*INVERSE), F.array(there, back)).otherwise(F.array(there))).alias("_e")).select("_e.*")


def lookup(refs: DataFrame, nodes: DataFrame, how: str = "inner", owner: bool = False) -> DataFrame:
    """``refs`` (name, path, and caller if ``owner``) with node_id of the last node of that name and path.

    With ``owner`` the node must belong to the caller, or to nobody if the caller is empty.
    """
    named = nodes.select(F.col("name"), normalize_path("path").alias("path"), F.col("id").alias("node_id"), *([F.coalesce("owner", F.lit("")).alias("owner")] if owner else []), "ordinal")
    named = first_by(named, ["name", "path"], "ordinal", last=True).drop("ordinal")
    found = refs.withColumn("path", normalize_path("path")).join(named, ["name", "path"], how)
    return found.where(F.col("owner") == F.coalesce("caller", F.lit(""))).drop("owner") if owner else found


def inverse_types(types: DataFrame) -> DataFrame:
    """types (name, extends, implements) with extended_by and implemented_by, sorted and distinct."""
    out = types
    for ours, theirs in (("extends", "extended_by"), ("implements", "implemented_by")):
        back = types.select("name", F.explode(ours).alias("_of")).groupBy("_of").agg(F.array_sort(F.collect_set("name")).alias(theirs)).withColumnRenamed("_of", "name")
        out = out.join(back, "name", "left").withColumn(theirs, F.coalesce(theirs, F.array().cast("array<string>")))
    return out


def merge_types(types: DataFrame) -> DataFrame:
    """One row per type key: parents of all its declarations, fields of later ones over earlier ones."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "extends", "implements", "fields")), lambda a, b: (a["ordinal"] - b["ordinal"]).cast("int"))
    one = types.groupBy("key").agg(parts.alias("p"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("p", lambda x: x[c])))
    fields = F.aggregate("p", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(x["fields"], k)), x["fields"]))
    return one.select("key", flat("extends").alias("extends"), flat("implements").alias("implements"), fields.alias("fields"))


def merge_snapshots(rows: DataFrame, key: str) -> DataFrame:
    """Of equal keys the one from the later file."""
    return first_by(rows, [key], "ordinal", last=True)


def with_origins(types: DataFrame, calls: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types whose parents are ``path::name`` where their file imports the name, and calls with target_file: where the file imports caller or callee from, else
    the file itself. imports: file, name, resolved, ordinal; of several of one name the last holds."""
    known = imports.groupBy("file", "name").agg(F.max_by("resolved", "ordinal").alias("resolved"))
    of_file = known.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "resolved"))).alias("_known"))
    joined = types.join(of_file, "file", "left")
    full = lambda column: F.transform(column, lambda x: F.coalesce(F.concat(F.try_element_at("_known", x), F.lit("::"), x), x))
    types = joined.withColumn("extends", full("extends")).withColumn("implements", full("implements")).drop("_known")
    target = F.when(F.col("caller") != "", F.try_element_at("_known", F.col("caller"))).otherwise(F.try_element_at("_known", F.col("name")))
    return types, calls.join(of_file, "file", "left").withColumn("target_file", F.coalesce(target, F.col("file"))).drop("_known")


def implementation_calls(functions: DataFrame, types: DataFrame, calls: DataFrame) -> DataFrame:
    """CALLS_IMPLEMENTATION edges (src, dst, type, ordinal): a call of a method of interface ``caller`` in ``target_file`` also calls the method of that
    name in the first class that implements the interface. ``implements`` holds ``path::name``, or a name of the class's own file."""
    ref = F.col("ref")
    path = F.regexp_extract(ref, r"^(.+\.[a-zA-Z0-9]+)::(.+)$", 1)
    declared = types.select(F.explode("implements").alias("ref"), F.col("name").alias("class_name"), F.col("file").alias("class_file"), "ordinal")
    declared = declared.select(normalize_path(F.when(path != "", path).otherwise(F.col("class_file"))).alias("path"), F.element_at(F.split(ref, "::"), -1).alias("caller"), "class_name", "class_file", "ordinal")
    first = declared.groupBy("path", "caller").agg(F.min_by(F.struct("class_name", "class_file"), F.struct("ordinal", "class_file", "class_name")).alias("c"))
    methods = functions.where("coalesce(class_name, '') <> ''").groupBy("class_name", F.col("file").alias("class_file"), F.col("name").alias("callee")).agg(F.min_by("id", F.struct("ordinal", "id")).alias("dst"))
    made = calls.select(F.col("function_id").alias("src"), "callee", normalize_path("target_file").alias("path"), "caller", "ordinal")
    return made.join(first, ["path", "caller"]).select("src", "callee", "ordinal", "c.class_name", "c.class_file").join(methods, ["class_name", "class_file", "callee"]).select("src", "dst", F.lit("CALLS_IMPLEMENTATION").alias("type"), "ordinal")


def with_owners(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """``nodes`` with owner and path of ``owners`` (id, owner, path, ordinal) where there are any; of several the last holds."""
    new = first_by(owners, ["id"], "ordinal", last=True).select("id", F.col("owner").alias("_owner"), F.col("path").alias("_path"))
    return nodes.join(new, "id", "left").withColumn("owner", F.coalesce("_owner", "owner")).withColumn("path", F.coalesce("_path", "path")).drop("_owner", "_path")


def enrich(functions: DataFrame, types: DataFrame, calls: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot.

    functions: id, name, file, class_name, ordinal. types: id, name, file, kind, extends, implements (``path::name`` references or names),
    ordinal. calls: function_id, callee, target_file, caller, ordinal. imports: file, symbol, resolved, ordinal. Every end is a node: ends are
    looked up among the nodes or are functions, types and files that nodes are made of, and calls of unknown functions are left out.
    """
    files = functions.select("file").union(types.select("file")).union(imports.select("file")).distinct()
    nodes = reduce(
        DataFrame.unionByName,
        [
            files.select(F.col("file").alias("id"), F.element_at(F.split("file", "/"), -1).alias("name"), F.col("file").alias("path"), F.lit("FILE").alias("type"), F.lit(None).cast("string").alias("owner"), F.lit(-1).cast("long").alias("ordinal")),
            types.select("id", "name", F.col("file").alias("path"), F.col("kind").alias("type"), F.lit(None).cast("string").alias("owner"), F.col("ordinal").cast("long").alias("ordinal")),
            functions.select("id", "name", F.col("file").alias("path"), F.lit("FUNCTION").alias("type"), F.nullif("class_name", F.lit("")).alias("owner"), F.col("ordinal").cast("long").alias("ordinal")),
        ],
    )
    nodes = written(dedup_nodes(nodes))
    calls = calls.join(nodes.select(F.col("id").alias("function_id")), "function_id", "left_semi")
    parts, wanted = [], []
    for column, kind in (("implements", "IMPLEMENTS"), ("extends", "EXTENDS")):
        refs = types.select(F.col("id").alias("src"), "file", "ordinal", F.explode(column).alias("ref"))
        path = F.regexp_extract("ref", r"^(.+\.[a-zA-Z0-9]+)::(.+)$", 1)
        wanted.append(refs.select("src", F.lit(kind).alias("type"), "ordinal", F.element_at(F.split("ref", "::"), -1).alias("name"), F.when(path != "", path).otherwise(F.col("file")).alias("path")))
    owners = functions.where("coalesce(class_name, '') <> ''").select(F.col("id").alias("dst"), F.col("class_name").alias("name"), F.col("file").alias("path"), "ordinal")
    parts.append(lookup(owners, nodes.where("type <> 'FUNCTION'")).select(F.col("node_id").alias("src"), "dst", F.lit("HAS_METHOD").alias("type"), "ordinal"))
    wanted.append(imports.select(F.col("file").alias("src"), F.lit("IMPORTS").alias("type"), "ordinal", F.col("symbol").alias("name"), F.col("resolved").alias("path")))
    parts.append(lookup(reduce(DataFrame.unionByName, wanted), nodes).select("src", F.col("node_id").alias("dst"), "type", "ordinal"))
    made = calls.select(F.col("function_id").alias("src"), F.col("callee").alias("name"), F.col("target_file").alias("path"), "caller", "ordinal")
    parts.append(lookup(made, nodes.where("type = 'FUNCTION'"), owner=True).select("src", F.col("node_id").alias("dst"), F.lit("CALLS").alias("type"), "ordinal"))
    parts.append(implementation_calls(functions, types, calls))
    forward = dedup_edges(reduce(DataFrame.unionByName, parts).where("src IS NOT NULL AND dst IS NOT NULL"))
    return nodes, with_inverse(forward)
