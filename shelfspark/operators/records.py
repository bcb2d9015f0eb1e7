"""Raw product documents under the registry: which records are accepted, which fields are nulled and why,
what no field models, and the typed specs and facets. The registry is compiled into small tables (a row
for each field, facet or input path of a category) that meet the documents by broadcast; paths into
the VARIANT document are columns then, so that one plan of fixed size serves all categories in one
scan, without Python and without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .categories import CATEGORIES, PORTS, RATES, tree
from .contract import UUID_V4, enum_value
from .order import stored

# fixed values: limits of the input contract
LIMITS = {"raw_bytes": 700000, "text": 200, "name": 1000, "url": 2048, "region": 32, "key": 1000, "array": 256, "number": 1e9, "nodes": 50000, "depth": 32, "year": 9999, "path": 200}
# fixed values: digits of identifier types, and control characters that no text may hold
IDENTIFIERS = {"ean": "^(\\d{8}|\\d{13})$", "upc": "^(\\d{8}|\\d{12})$", "jan": "^(\\d{8}|\\d{13})$", "gtin": "^(\\d{8}|\\d{12,14})$"}
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
NO_ISSUES = "array<struct<code: string, field: string>>"


# ---------------------------------------------------------------- values of the document

def at(doc: Column, path: str | Column) -> Column:
    """The value at a dotted path, which may differ by row; null where there is none."""
    return F.try_variant_get(doc, f"$.{path}" if isinstance(path, str) else F.concat(F.lit("$."), path), "variant")


def kind(v: Column) -> Column:
    """string, number, boolean, object, array, or null (for JSON's null and for no value)."""
    s = F.schema_of_variant(v)
    named = F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
    return F.when(v.isNotNull() & (s != "VOID"), named.otherwise("number"))


def string_of(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def units(s: Column) -> Column:
    """Length in UTF-16 units, in which limits are stated."""
    return F.length(s) + F.regexp_count(s, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def safe_text(v: Column, most: int = LIMITS["text"]) -> Column:
    """A string that is not blank, not too long and without control characters; else null."""
    s = string_of(v)
    return F.when(F.regexp_like(s, F.lit("\\S")) & (units(s) <= most) & ~F.regexp_like(s, F.lit(CONTROL)), s)


def safe_number(v: Column) -> Column:
    n = number_of(v)
    return F.when((n >= 0) & (n <= LIMITS["number"]), n)


def safe_whole(v: Column) -> Column:
    n = safe_number(v)
    return F.when(n == F.floor(n), n.cast("bigint"))


def truth(v: Column) -> Column:
    return F.when(kind(v) == "boolean", F.try_variant_get(v, "$", "boolean"))


def elements(v: Column) -> Column:
    """The elements of an array of bounded size; else null."""
    a = F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))
    return F.when(F.size(a) <= LIMITS["array"], a)


def texts(array: Column) -> Column:
    """The sound texts of an array, cleaned."""
    return F.array_compact(F.transform(array, lambda x: C.clean_text(safe_text(x))))


def once(rows: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each computed once whatever reads it later: a generator of one row,
    which the optimizer neither copies into its readers nor moves filters below."""
    return rows.select(*keep, F.inline(F.array(F.struct(*columns))))


# ---------------------------------------------------------------- specs and facets

def _keyed(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` as (key, category, doc), so that no name of the caller's clashes with ours."""
    return docs.select(F.struct(*keys).alias("key"), "category", "doc")


def _meet(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Each document beside every row of its category. The broadcast side is the registry: its size
    is fixed."""
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame(rows, f"category string, {schema}")), "category")


def field_rows(categories: list[str] | None = None) -> list[tuple]:
    """(category, field, conversion, wanted, p1, p2, p3): a field with a second source names both
    conversions; its paths follow one another."""
    out = []
    for c in (CATEGORIES[n] for n in categories or CATEGORIES):
        for f in c.fields:
            paths = [p for s in f.sources for p in s.paths]
            wanted = [v for s in f.sources for v in s.values]
            out.append((c.name, f.name, "|".join(s.conversion for s in f.sources), wanted, *paths, *[None] * (3 - len(paths))))
    return out


def spec_values(docs: DataFrame, keys: list[str], categories: list[str] | None = None) -> DataFrame:
    """(keys, category, field, text, number) of every known spec of all categories, in one scan. ``docs``
    has ``keys``, category and doc (variant). A source of the wrong type or beyond the contract's limits is
    unknown, and unknown specs have no row."""
    own = ["key", "category", "field", "conversion", "wanted"]
    met = _meet(_keyed(docs, keys), field_rows(categories), "field string, conversion string, wanted array<string>, p1 string, p2 string, p3 string")
    values = once(met, own, *[at(F.col("doc"), F.col(f"p{i}")).alias(f"v{i}") for i in (1, 2, 3)])
    kinds = once(values, [*own, "v1", "v2", "v3"], *[kind(F.col(f"v{i}")).alias(f"k{i}") for i in (1, 2, 3)])
    held = once(
        kinds, own, F.when(F.col("k1") == "array", F.try_variant_get("v1", "$", "array<variant>")).alias("array"), F.when(F.col("k1") == "boolean", F.try_variant_get("v1", "$", "boolean")).alias("b"),
        *[F.when(F.col(f"k{i}") == "string", F.try_variant_get(f"v{i}", "$", "string")).alias(f"s{i}") for i in (1, 2, 3)], *[F.when(F.col(f"k{i}") == "number", F.try_variant_get(f"v{i}", "$", "double")).alias(f"x{i}") for i in (1, 2, 3)],
    )
    sound = lambda i: F.regexp_like(f"s{i}", F.lit("\\S")) & (units(F.col(f"s{i}")) <= LIMITS["text"]) & ~F.regexp_like(f"s{i}", F.lit(CONTROL))
    n = lambda i: F.when(F.col(f"x{i}").between(0, LIMITS["number"]), F.col(f"x{i}"))
    safe = once(held, [*own, "b"], F.when(F.size("array") <= LIMITS["array"], F.col("array")).alias("array"), *[F.when(sound(i), C.clean_text(F.col(f"s{i}"))).alias(f"t{i}") for i in (1, 2, 3)], *[n(i).alias(f"n{i}") for i in (1, 2, 3)])
    family = F.when(F.col("conversion").isin("family", "generation"), C.cpu_family(F.col("t1"), F.col("t2"), F.col("t3")))
    named = once(safe, [c for c in safe.columns if c != "t3"], family.alias("named"))
    of = lambda name, c: F.when(F.col("conversion").startswith(name), c)
    named = once(named, named.columns, of("pcie", C.pcie(F.col("t1"))[0]).alias("pcie"), of("pcie", C.pcie(F.col("t1"))[1]).cast("double").alias("lanes"))
    named = once(named, named.columns, of("series", C.gpu_series(F.col("t1"))).alias("series"), F.when(F.col("conversion") == "brand", C.brand(F.col("t1"))).otherwise(of("socket", C.socket(F.col("t1")))).alias("spelled"))
    t1, n1, n2, n3 = (F.col(x) for x in ("t1", "n1", "n2", "n3"))
    whole = lambda x: F.when(x == F.floor(x), x)
    above = lambda x: F.when(x > 0, x)
    known = F.forall("array", lambda x: F.coalesce(safe_text(x).isin("XMP", "EXPO"), F.lit(False)))
    text = {
        "text": t1, "brand": F.col("spelled"), "socket": F.col("spelled"), "series": F.col("series"), "family": F.col("named.family"),
        "generation": F.col("named.generation"), "text|one_of": F.coalesce(t1, F.when(F.array_contains("wanted", F.col("t2")), F.col("t2"))),
    }
    number = {
        "number": n1, "positive": above(n1), "integer": whole(n1), "count": above(whole(n1)), "flag": F.col("b").cast("double"), "sum": whole(n1) + whole(n2), "number|number": F.coalesce(n1, n2),
        "positive|product": F.coalesce(above(n1), above(n2 * n3)), "pcie_generation": F.col("pcie"), "pcie_lanes": F.col("lanes"), "rate": enum_value(t1, RATES).cast("double"),
        "size": F.when(F.forall("array", lambda x: F.coalesce(kind(x) == "object", F.lit(False))), F.size("array")).cast("double"),
        "holds": F.when(known, F.exists("array", lambda x: F.try_variant_get(x, "$", "string") == F.get("wanted", F.lit(0)))).cast("double"),
    }
    pick = lambda of: reduce(lambda acc, kv: acc.when(F.col("conversion") == kv[0], kv[1]), of.items(), F)
    out = once(named, ["key", "category", "field"], pick(text).alias("text"), pick(number).alias("number"))
    return out.filter(F.col("text").isNotNull() | F.col("number").isNotNull()).select("key.*", "category", "field", "text", "number")


def typed(values: DataFrame, category: str, keys: list[str]) -> DataFrame:
    """The category's typed table from ``spec_values``: ``keys`` and a column for each of its fields."""
    cell = lambda f: F.max(F.when(F.col("field") == f.name, F.col("text" if f.type == "string" else "number"))).cast(f.type).alias(f.name)
    return values.filter(F.col("category") == category).groupBy(*keys).agg(*[cell(f) for f in CATEGORIES[category].fields])


def facet_values(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, attribute, value) of every facet of all categories, each once, in one scan."""
    rows = [(c.name, f.name, f.sources[0].conversion, f.sources[0].paths[0]) for c in CATEGORIES.values() for f in c.facets]
    met = once(_meet(_keyed(docs, keys), rows, "attribute string, conversion string, path string"), ["key", "category", "attribute", "conversion"], at(F.col("doc"), F.col("path")).alias("v"))
    opened = once(met, ["key", "category", "attribute", "conversion", "v"], elements(F.col("v")).alias("array"))
    listed = once(opened, ["key", "category", "attribute", "conversion", "v"], texts(F.col("array")).alias("texts"))
    ports = F.array_compact(F.array(*[F.when(safe_whole(at(F.col("v"), p)) > 0, p) for p in PORTS]))
    own = F.when(F.col("conversion") == "present", ports).when(F.col("conversion") == "socket", F.transform("texts", C.socket)).otherwise(F.col("texts"))
    return listed.select("key.*", "category", "attribute", F.explode(F.array_distinct(own)).alias("value"))


# ---------------------------------------------------------------- records

def bare(raw: Column) -> Column:
    """A JSON text without its texts (one letter each), blanks and empty containers."""
    short = F.regexp_replace(F.regexp_replace(raw, '"(?:[^"\\\\]|\\\\.)*+"', "s"), "\\s+", "")
    return F.regexp_replace(short, "\\{\\}|\\[\\]", "s")


def structure(bare: Column) -> Column:
    """(nodes, depth) of a valid JSON text from its ``bare`` form, in which every comma and every
    bracket that opens stands for a node. Only texts with many brackets are walked for their depth."""
    brackets = F.regexp_replace(bare, "[^\\[\\]{}]", "")
    step = lambda acc, x: F.struct((acc["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(x.isin("[", "{"), 1).otherwise(0)).alias("most"))
    walked = F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])
    nodes = 1 + F.length(F.regexp_replace(bare, "[^,\\[{]", ""))
    return F.struct(nodes.alias("nodes"), F.when(F.length(brackets) > 2 * LIMITS["depth"], walked).otherwise(F.length(brackets) / 2).cast("int").alias("depth"))


def rejected(raw: DataFrame) -> DataFrame:
    """``raw`` (category and raw, beside others) with ``doc`` and ``code``: the first rule of the
    contract that a record breaks, or 'accepted'. Every record gets a code; none is dropped."""
    doc, columns = F.col("doc"), raw.columns
    docs = once(raw, columns, F.try_parse_json("raw").alias("doc"), bare(F.col("raw")).alias("__bare"))
    parts = (kind(doc).alias("__root"), F.lower(string_of(at(doc, "opendb_id"))).alias("__id"), safe_text(at(doc, "metadata.name"), LIMITS["name"]).alias("__name"), F.when(doc.isNotNull(), structure(F.col("__bare"))).alias("__size"))
    facts = once(docs, [*columns, "doc"], *parts)
    holds = lambda c: F.coalesce(c, F.lit(False))
    code = (
        F.when(doc.isNull(), "invalid_json").when(~holds(F.col("category").isin(*CATEGORIES)), "unsupported_category").when(~holds(F.col("__root") == "object"), "invalid_structure")
        .when(~holds(F.regexp_like("__id", F.lit(UUID_V4))), "invalid_identity").when(~holds(F.regexp_like("__name", F.lit("[\\p{L}\\p{N}]"))), "invalid_name")
        .when((F.col("__size.nodes") > LIMITS["nodes"]) | (F.col("__size.depth") > LIMITS["depth"]), "raw_structure_limit").when(F.octet_length("raw") > LIMITS["raw_bytes"], "raw_size_limit").otherwise("accepted")
    )
    return once(facts, [*columns, "doc"], code.alias("code"))


def unmodeled(docs: DataFrame) -> DataFrame:
    """(category, path, n): fields that stand in documents and in no part of the registry, at any level
    of its tree. Objects are opened level by level while the registry goes on below them; a field
    that it does not know is counted whole and not opened. Each level is stored: it feeds the counts and
    the next level."""
    known = [(c, p, inner) for c in CATEGORIES for p, inner in tree(c).items()]
    paths = F.broadcast(docs.sparkSession.createDataFrame(known, "category string, path string, inner boolean"))  # a row for each path of the registry
    level = docs.select("category", F.lit("").alias("prefix"), F.col("doc").alias("value"))
    counts = []
    for _ in range(max(p.count(".") for _, p, _ in known) + 1):
        held = F.try_variant_get("value", "$", "map<string,variant>")
        keys = level.filter(kind(F.col("value")) == "object").select("category", "prefix", F.explode(held).alias("key", "value"))
        found = stored(keys.select("category", F.concat_ws(".", F.nullif("prefix", F.lit("")), "key").alias("path"), "value").join(paths, ["category", "path"], "left"))
        counts.append(found.filter("inner is null").groupBy("category", F.substring("path", 1, LIMITS["path"]).alias("path")).agg(F.count("*").alias("n")))
        level = found.filter("inner").select("category", F.col("path").alias("prefix"), "value")
    return reduce(DataFrame.unionByName, counts).groupBy("category", "path").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- field issues

def _issue(bad: Column, code: str, field: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), field.alias("field")))


def _numbered(array: Column, bad, path: Column, code: str) -> Column:
    """An issue for each element that ``bad`` names, with its place."""
    found = F.transform(array, lambda x, i: _issue(bad(x), code, F.concat_ws("/", path, i.cast("string"))))
    return F.coalesce(F.array_compact(found), F.array().cast(NO_ISSUES))


def input_issues(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, code, field): values that are not what the registry asks for at their paths."""
    rows = []
    for c in CATEGORIES.values():
        for path, type_ in c.inputs().items():
            parts = path.split(".")
            above = [".".join(parts[:i]) for i in range(1, len(parts))]
            rows.append((c.name, path, type_, *above, *[None] * (2 - len(above))))
    doc, path, type_ = F.col("doc"), F.col("path"), F.col("type")
    met = _meet(_keyed(docs, keys), rows, "path string, type string, above1 string, above2 string")
    values = once(met, ["key", "category", "path", "type", "above1", "above2"], kind(at(doc, F.col("above1"))).alias("ka"), kind(at(doc, F.col("above2"))).alias("kb"), at(doc, path).alias("v"))
    there = once(values, ["key", "category", "path", "type", "above1", "above2", "ka", "kb", "v"], kind(F.col("v")).alias("k"), elements(F.col("v")).alias("array"), safe_number(F.col("v")).alias("x"))
    plain = F.array_compact(F.array(_issue(F.col("ka") != "object", "invalid_object", F.col("above1")), _issue(F.col("kb") != "object", "invalid_object", F.col("above2"))))
    url = path.endswith("manufacturer_url")
    sound = (
        F.when(type_ == "text", F.when(url, safe_text(F.col("v"), LIMITS["url"])).otherwise(safe_text(F.col("v"))).isNotNull()).when(type_ == "number", F.col("x").isNotNull())
        .when(type_ == "integer", F.coalesce((F.col("x") == F.floor("x")) & ((path != "metadata.releaseYear") | (F.col("x") <= LIMITS["year"])), F.lit(False))).when(type_ == "boolean", F.col("k") == "boolean")
    )
    no_text = lambda x: safe_text(x).isNull() | ((path == "metadata.part_numbers") & (units(C.identifier_key(safe_text(x))) > LIMITS["key"]))
    odd = F.exists("array", lambda x: ~F.coalesce(safe_text(x).isin("XMP", "EXPO"), F.lit(False)))
    no_object = F.exists("array", lambda x: F.coalesce(kind(x) != "object", F.lit(True)))
    one = lambda *i: F.array_compact(F.array(*i))
    of_type = (
        F.when(~type_.isin("array", "objects"), one(_issue(~sound, "invalid_value", path))).when(F.col("array").isNull(), one(_issue(F.lit(True), "invalid_array", path)))
        .when(type_ == "objects", one(_issue(no_object, "invalid_array_element", path)))
        .otherwise(F.concat(_numbered(F.col("array"), no_text, path, "invalid_array_element"), one(_issue((path == "profile_support") & odd, "unknown_semantic_value", path))))
    )
    return there.select("key.*", "category", F.inline(F.concat(plain, F.when(F.col("k").isNotNull(), of_type).otherwise(F.array().cast(NO_ISSUES)))))


def identifier_issues(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, code, field): identifier lists of another layout, and elements that are no identifiers."""
    ids = _keyed(docs, keys).select("key", "category", at(F.col("doc"), "identifiers").alias("ids")).withColumn("k", kind(F.col("ids"))).filter("k is not null")
    own = F.col("ids")
    facts = once(ids, ["key", "category"], (F.col("k") == "object").alias("o"), safe_whole(at(own, "version")).alias("version"), elements(at(own, "identifiers")).alias("listed"), (at(own, "schema_version").isNotNull() | at(own, "format_version").isNotNull()).alias("other"))
    known = once(facts, ["key", "category", "listed"], F.coalesce(F.col("o") & (F.col("version") >= 1) & F.col("listed").isNotNull() & ~F.col("other"), F.lit(False)).alias("ok"))
    layout = known.filter("not ok").select("key.*", "category", F.lit("unsupported_identifiers").alias("code"), F.lit("identifiers").alias("field"))
    each = known.filter("ok").select("key", "category", F.posexplode("listed").alias("i", "x"))
    parts = once(each, ["key", "category", "i"], string_of(at(F.col("x"), "type")).alias("type"), safe_text(at(F.col("x"), "value")).alias("value"), safe_text(at(F.col("x"), "region"), LIMITS["region"]).alias("region"))
    digits = reduce(lambda acc, kv: acc.when(F.col("type") == kv[0], F.regexp_like(F.trim("value"), F.lit(kv[1]))), IDENTIFIERS.items(), F.when(F.col("type") == "mpn", F.lit(True)))
    good = F.coalesce(digits & F.col("value").isNotNull() & F.col("region").isNotNull() & (units(C.identifier_key(F.col("value"))) <= LIMITS["key"]), F.lit(False))
    bad = parts.filter(~good).select("key.*", "category", F.lit("invalid_identifier").alias("code"), F.concat(F.lit("identifiers.identifiers/"), F.col("i").cast("string")).alias("field"))
    return layout.unionByName(bad)


def issues(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Every field rule that an accepted record breaks; the record itself survives."""
    return input_issues(docs, keys).unionByName(identifier_issues(docs, keys))
