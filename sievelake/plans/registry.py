"""Registered queries over the driver tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.predicate import all_like, any_like, ilike, like, not_ilike, not_like
from sievelake.operators import bitmaps, search
from sievelake.plans.planner import Predicate as P
from sievelake.plans.planner import where
from sievelake.sources import catalog
from sievelake.functions import sql
from sievelake.sources.files import fresh_folder, with_lowered
from sievelake.sources.index import CLEANUP, PatternIndex, _stamp
from sievelake.sources.partitioned import PartitionedIndex
from sievelake.streaming import filters

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key], _SQL[key] = f, sql
        return f

    return add


def _simple(name: str, table: str, columns: str, condition, sql: str) -> None:
    """A filter of one table: ``condition`` is built when the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table).where(condition()).select(*columns.split(", "))

    query(f"SELECT {columns} FROM {table} WHERE {sql}", name)(run)


_PART = "p_partkey, p_name"
_ESC = r" ESCAPE '\'"


def _like(name: str, pattern: str, table: str = "part", columns: str = _PART, column: str = "p_name") -> None:
    esc = _ESC if "\\" in pattern else ""
    _simple(f"like_{name}", table, columns, lambda: like(column, pattern), f"{column} LIKE '{pattern}'{esc}")


for _name, _pattern in {
    "exact": "small ring", "prefix": "small%", "suffix": "%ring", "substring": "%l r%", "infix": "s%g", "multi_part": "%a%r%n%", "multi_part_anchored": "s%l%ng",
    "underscore_exact": "_mall ring", "underscore_prefix": "s_al%", "underscore_suffix": "%r_ng", "underscore_substring": "%_l%r_n%", "empty": "", "all": "%",
    "min_len": "%___%", "exact_len": "_______", "double_percent": "%%", "percent_runs": "small%%%ring", "one_letter": "%g%", "underscore_edges": "_%_", "repeat": "%l%l%l%",
}.items():
    _like(_name, _pattern)
_like("newline", "%._%", "documents", "doc_id", "text")
_like("long_text", "%the%and%ing%of%", "documents", "doc_id", "text")
_like("accent", "%é%", "documents", "doc_id", "text")
_like("escape_pct", "%\\%%", "documents", "doc_id", "text")
_like("escape_pct_html", "%\\%%", "pages", "page_id", "html")
_like("json_text", '{"k": 6_}', "events", "event_id, props", "props")
_like("url", "http%://%/fr/%", "pages", "page_id, url", "url")
_like("phone_digits", "Customer#%0_1", "customer", "c_custkey, c_name", "c_name")
_simple("like_escape_other", "customer", "c_custkey, c_name", lambda: like("c_name", "Customer\\#%1"), "c_name LIKE 'Customer#%1'")
_simple("like_escape_clause", "customer", "c_custkey, c_name", lambda: like("c_name", "Customer!#%1", escape="!"), "c_name LIKE 'Customer!#%1' ESCAPE '!'")
_simple("like_escape_und", "part", "p_partkey", lambda: like(F.replace("p_name", F.lit(" "), F.lit("_")), r"%\_r%"), rf"replace(p_name, ' ', '_') LIKE '%\_r%'{_ESC}")
_simple("like_escape_bs", "part", "p_partkey", lambda: like(F.replace("p_name", F.lit(" "), F.lit("\\")), r"%\\r%"), rf"replace(p_name, ' ', '\') LIKE '%\\r%'{_ESC}")
_simple("like_null_pattern", "part", _PART, lambda: like("p_name", None), "p_name LIKE NULL")
for _name, _pattern in {"exact": "SMALL RING", "prefix": "SMALL%", "suffix": "%RING", "substring": "%L R%", "multi": "%A%R%N%", "underscore": "S_ALL%R_NG"}.items():
    _simple(f"ilike_{_name}", "part", _PART, lambda p=_pattern: ilike("p_name", p), f"p_name ILIKE '{_pattern}'")
_simple("ilike_accent", "documents", "doc_id", lambda: ilike("text", "%É%"), "text ILIKE '%É%'")
_simple("not_like", "part", _PART, lambda: not_like("p_name", "%ring%"), "p_name NOT LIKE '%ring%'")
_simple("not_ilike", "part", _PART, lambda: not_ilike("p_name", "%RING%"), "p_name NOT ILIKE '%RING%'")
_simple("not_like_all", "part", _PART, lambda: not_like("p_name", "%"), "p_name NOT LIKE '%'")
_simple("not_like_parts", "part", _PART, lambda: not_like("p_name", "%a%_r%n%"), "p_name NOT LIKE '%a%_r%n%'")
_NULLED = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END"
_simple("not_like_null", "part", _PART, lambda: not_like(F.expr(_NULLED), "%ring%"), f"({_NULLED}) NOT LIKE '%ring%'")
_simple("not_ilike_null", "part", _PART, lambda: not_ilike(F.expr(_NULLED), "%RI_G%"), f"({_NULLED}) NOT ILIKE '%RI_G%'")
_simple("null_or_like", "part", _PART, lambda: F.expr(_NULLED).isNull() | like(F.expr(_NULLED), "small%"), f"({_NULLED}) IS NULL OR ({_NULLED}) LIKE 'small%'")
_simple("or_like", "part", _PART, lambda: any_like("p_name", ["small%", "%ring"]), "p_name LIKE 'small%' OR p_name LIKE '%ring'")
_simple("like_any_columns", "part", _PART, lambda: like("p_name", "%ring") | like("p_brand", "%#1%"), "p_name LIKE '%ring' OR p_brand LIKE '%#1%'")
_simple("like_all_of", "part", _PART, lambda: all_like("p_name", ["s%", "%r%"]), "p_name LIKE 's%' AND p_name LIKE '%r%'")
_simple(
    "nested_bool", "part", _PART, lambda: (like("p_name", "s%") | like("p_name", "%g")) & (not_like("p_brand", "%1") | ilike("p_type", "%A%")),
    "(p_name LIKE 's%' OR p_name LIKE '%g') AND (p_brand NOT LIKE '%1' OR p_type ILIKE '%A%')",
)
_simple("not_or", "part", _PART, lambda: ~(like("p_name", "s%") | like("p_name", "%g")), "NOT (p_name LIKE 's%' OR p_name LIKE '%g')")
_simple("lower_expr_like", "part", _PART, lambda: like(F.lower("p_name"), "%ring"), "lower(p_name) LIKE '%ring'")
_simple("cast_expr_like", "part", "p_partkey, p_size", lambda: like(F.col("p_size").cast("string"), "1%"), "CAST(p_size AS VARCHAR) LIKE '1%'")
_simple("partial_index_like", "part", _PART, lambda: (F.col("p_size") > 10) & like("p_name", "%ring"), "p_size > 10 AND p_name LIKE '%ring'")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l%' AND p_name NOT LIKE 's%' AND p_name ILIKE '%G'")
def and_same_column(spark, sf_dir):
    return where(_table(spark, sf_dir, "part"), [P("p_name", "LIKE", "%l%"), P("p_name", "NOT LIKE", "s%"), P("p_name", "ILIKE", "%G")]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND p_brand LIKE 'Brand#1%' AND p_type LIKE '%A%'")
def and_multi_column(spark, sf_dir):
    return where(_table(spark, sf_dir, "part"), [P("p_type", "LIKE", "%A%"), P("p_name", "LIKE", "%ring"), P("p_brand", "LIKE", "Brand#1%")]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING' AND p_brand NOT LIKE 'Brand#1%' AND p_type NOT ILIKE '%x%'")
def and_mixed_ops(spark, sf_dir):
    return where(_table(spark, sf_dir, "part"), [P("p_name", "ILIKE", "%RING"), P("p_brand", "NOT LIKE", "Brand#1%"), P("p_type", "NOT ILIKE", "%x%")]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND p_size BETWEEN 5 AND 30 AND p_retailprice > 950 AND p_brand = 'Brand#1'")
def mixed_filters(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return where(part, [P("p_name", "LIKE", "%ring")], F.col("p_size").between(5, 30), F.col("p_retailprice") > 950, F.col("p_brand") == "Brand#1").select("p_partkey")


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE 'small%' AND l_returnflag LIKE '_' AND l_quantity >= 10")
def joined_filters(spark, sf_dir):
    part = _table(spark, sf_dir, "part").where(like("p_name", "small%")).select("p_partkey")
    lines = _table(spark, sf_dir, "lineitem").where(like("l_returnflag", "_") & (F.col("l_quantity") >= 10))
    return lines.join(part, lines["l_partkey"] == part["p_partkey"], "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


_PATTERNS = ("small%", "%ring", "%a%r%", "_____ %")
_VALUES = ", ".join(f"('{p}')" for p in _PATTERNS)


@query(f"SELECT p_partkey, pattern FROM part JOIN (VALUES {_VALUES}) v(pattern) ON p_name LIKE pattern")
def pattern_join(spark, sf_dir):
    patterns = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    return search.pattern_join(_table(spark, sf_dir, "part"), "p_name", patterns).select("p_partkey", "pattern")


@query("SELECT p_partkey FROM part WHERE p_name LIKE concat('%', split_part(p_name, ' ', 2))")
def column_pattern_like(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.where(like("p_name", F.concat(F.lit("%"), F.element_at(F.split("p_name", " "), 2)))).select("p_partkey")


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE '%ring%'")
def count_like(spark, sf_dir):
    return search.count(_table(spark, sf_dir, "part"), [P("p_name", "LIKE", "%ring%")])


@query("SELECT EXISTS (SELECT 1 FROM part WHERE p_name LIKE '%ring%') AS found")
def exists_like(spark, sf_dir):
    return search.exists(_table(spark, sf_dir, "part"), [P("p_name", "LIKE", "%ring%")])


@query("SELECT EXISTS (SELECT 1 FROM part WHERE p_name LIKE '%zzz%') AS found")
def exists_like_none(spark, sf_dir):
    return search.exists(_table(spark, sf_dir, "part"), [P("p_name", "LIKE", "%zzz%")])


@query("SELECT event_type, count(*) AS n FROM events WHERE props LIKE '%6%' GROUP BY event_type")
def group_count_like(spark, sf_dir):
    return search.group_count(_table(spark, sf_dir, "events"), ["event_type"], [P("props", "LIKE", "%6%")])


@query("SELECT count(*) FILTER (WHERE p_name LIKE 's%') AS prefix, count(*) FILTER (WHERE p_name ILIKE '%RING') AS suffix, count(*) FILTER (WHERE p_name NOT LIKE '%a%') AS without_a FROM part")
def count_filter(spark, sf_dir):
    return search.count_filters(_table(spark, sf_dir, "part"), {"prefix": P("p_name", "LIKE", "s%"), "suffix": P("p_name", "ILIKE", "%RING"), "without_a": P("p_name", "NOT LIKE", "%a%")})


_ORDER = "ORDER BY p_retailprice DESC, p_partkey"


@query(f"SELECT p_partkey, p_retailprice FROM part WHERE p_name LIKE '%r%' {_ORDER} LIMIT 10")
def topk_like(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return search.search(part, [P("p_name", "LIKE", "%r%")], columns=["p_partkey", "p_retailprice"], order_by=[F.desc("p_retailprice"), F.asc("p_partkey")], limit=10)


@query(f"SELECT p_partkey, p_retailprice FROM part WHERE p_name LIKE '%r%' {_ORDER} LIMIT 10 OFFSET 20")
def offset_like(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return search.search(part, [P("p_name", "LIKE", "%r%")], columns=["p_partkey", "p_retailprice"], order_by=[F.desc("p_retailprice"), F.asc("p_partkey")], limit=10, offset=20)


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING'")
def ilike_stored_lower(spark, sf_dir):
    part = with_lowered(_table(spark, sf_dir, "part"), "p_name")
    return part.where(ilike("p_name", "%RING", lowered="p_name_lower")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%l%' EXCEPT SELECT p_partkey FROM part WHERE p_name LIKE 's%'")
def except_like(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.where(like("p_name", "%l%")).select("p_partkey").subtract(part.where(like("p_name", "s%")).select("p_partkey"))


# -- stored index ---------------------------------------------------------------------------------------------------


def _fresh(spark: SparkSession) -> str:
    return fresh_folder(spark, "index")


_BUILT: dict[tuple, str] = {}


def _index(spark: SparkSession, sf_dir: str) -> PatternIndex:
    """The index on part that all read-only queries of a session share, as long as the table is the same."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, f"{sf_dir}/part.parquet"))
    if key not in _BUILT:
        part = _table(spark, sf_dir, "part")
        _BUILT[key] = PatternIndex.build(part, _fresh(spark), {"p_name": "p_name", "p_brand": "p_brand", "nulled": _NULLED}, "part_names").path
    return PatternIndex(spark, _BUILT[key])


def _own(spark: SparkSession, sf_dir: str) -> PatternIndex:
    """An index that one query may change."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return PatternIndex.build(part, _fresh(spark), ["p_name"])


def _indexed(name: str, predicates: list[P], sql: str) -> None:
    query(f"SELECT p_partkey FROM part WHERE {sql}", f"index_{name}")(lambda spark, sf_dir: _index(spark, sf_dir).search(predicates).select("p_partkey"))


for _name, _pattern in {
    "exact": "small ring", "prefix": "small%", "suffix": "%ring", "substring": "%l r%", "infix": "s%g", "multi_part": "%a%r%n%", "multi_anchored": "s%l%ng", "underscore": "%_l%r_n%",
    "underscore_suffix": "%r_ng", "length": "%___%", "exact_length": "_______", "empty": "", "none": "%zzz%", "mixed_gap": "s_%_%n_",
}.items():
    _indexed(_name, [P("p_name", "LIKE", _pattern)], f"p_name LIKE '{_pattern}'")
_indexed("ilike", [P("p_name", "ILIKE", "%L R_N%")], "p_name ILIKE '%L R_N%'")
_indexed("not_like", [P("p_name", "NOT LIKE", "%ring%")], "p_name NOT LIKE '%ring%'")
_indexed("not_like_null", [P("nulled", "NOT LIKE", "%ring%")], f"({_NULLED}) NOT LIKE '%ring%'")
_indexed("null_other_key", [P("p_name", "LIKE", "%ring"), P("p_brand", "LIKE", "%1%")], "p_name LIKE '%ring' AND p_brand LIKE '%1%'")
_indexed("multi_column", [P("p_name", "LIKE", "%ring"), P("p_brand", "NOT LIKE", "Brand#1%"), P("nulled", "ILIKE", "S%")], f"p_name LIKE '%ring' AND p_brand NOT LIKE 'Brand#1%' AND ({_NULLED}) ILIKE 'S%'")


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE '%r_n%'")
def index_count(spark, sf_dir):
    return _index(spark, sf_dir).count([P("p_name", "LIKE", "%r_n%")])


def _bits(index: PatternIndex, pattern: str) -> DataFrame:
    return bitmaps.create(index.ids([P("p_name", "LIKE", pattern)]), parts=index.parts)


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE 's%' AND p_name LIKE '%ring'")
def bitmap_and_count(spark, sf_dir):
    index = _index(spark, sf_dir)
    return bitmaps.count(bitmaps.intersection(_bits(index, "s%"), _bits(index, "%ring")))


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE 's%' OR p_name LIKE '%ring'")
def bitmap_or_count(spark, sf_dir):
    index = _index(spark, sf_dir)
    return bitmaps.count(bitmaps.union(_bits(index, "s%"), _bits(index, "%ring")))


@query("SELECT p_partkey FROM part WHERE p_name LIKE 's%' AND p_name NOT LIKE '%ring'")
def bitmap_andnot_rows(spark, sf_dir):
    index = _index(spark, sf_dir)
    left = bitmaps.difference(_bits(index, "s%"), _bits(index, "%ring"))
    return index.fetch(bitmaps.to_ids(left)).select("p_partkey")


_NEW = "SELECT p_partkey + 100000000 AS p_partkey, 'zz ' || p_name AS p_name, p_size FROM part"


def _additions(part: DataFrame) -> DataFrame:
    """A batch as large as the table."""
    return part.select((F.col("p_partkey") + 100_000_000).alias("p_partkey"), F.concat(F.lit("zz "), F.col("p_name")).alias("p_name"), "p_size")


@query(f"SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, p_size FROM part UNION ALL {_NEW}) WHERE p_name LIKE 'zz%' OR p_name LIKE '%ring'")
def maint_insert(spark, sf_dir):
    index = _own(spark, sf_dir)
    index.append(_additions(_table(spark, sf_dir, "part")))
    ids = index.ids([P("p_name", "LIKE", "zz%")]).union(index.ids([P("p_name", "LIKE", "%ring")]))
    return index.fetch(ids).select("p_partkey", "p_name")


@query("SELECT p_partkey, n FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'new ' || p_name ELSE p_name END AS n FROM part) WHERE n LIKE 'new %' OR n LIKE 'small%'")
def maint_update(spark, sf_dir):
    index = _own(spark, sf_dir)
    index.update(F.col("p_partkey") % 10 == 3, {"p_name": F.concat(F.lit("new "), F.col("p_name"))})
    ids = index.ids([P("p_name", "LIKE", "new %")]).union(index.ids([P("p_name", "LIKE", "small%")]))
    return index.fetch(ids).select("p_partkey", F.col("p_name").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND NOT p_partkey % 5 = 0")
def maint_delete(spark, sf_dir):
    index = _own(spark, sf_dir)
    index.delete(F.col("p_partkey") % 5 == 0)
    return index.search([P("p_name", "LIKE", "%ring")]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring' AND NOT p_partkey % 3 = 0")
def maint_compact(spark, sf_dir):
    index = _own(spark, sf_dir)
    index.delete(F.col("p_partkey") % 3 == 0)
    index.compact()
    index.vacuum()
    return index.search([P("p_name", "NOT LIKE", "%ring")]).select("p_partkey")


@query(f"SELECT p_partkey FROM (SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, p_name FROM ({_NEW})) WHERE upper(p_name) LIKE '%RING'")
def maint_rebuild(spark, sf_dir):
    index = _own(spark, sf_dir)
    index.delete(F.col("p_partkey") % 4 == 0)
    index.append(_additions(_table(spark, sf_dir, "part")))
    index.rebuild({"upper": "upper(p_name)"})
    return index.search([P("upper", "LIKE", "%RING")]).select("p_partkey")


@query(
    f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 = 0) AS gone, max(length(p_name)) AS longest FROM part)
    SELECT 2 * n - gone AS active, 2 * n AS slots, CASE WHEN gone >= {CLEANUP} THEN gone ELSE 0 END AS free, CASE WHEN gone >= {CLEANUP} THEN 0 ELSE gone END AS tombstones,
    n AS inserts, gone AS deletes, 0::BIGINT AS updates, longest + 3 AS max_len FROM c"""
)
def index_stats(spark, sf_dir):
    """Deletions below the bound of the cleanup stay marked, others free their slots."""
    index, part = _own(spark, sf_dir), _table(spark, sf_dir, "part")
    index.append(_additions(part))
    index.delete((F.col("p_partkey") % 5 == 0) & (F.col("p_partkey") < 100_000_000))
    return index.stats().select("active", "slots", "free", "tombstones", "inserts", "deletes", "updates", F.col("max_len").cast("long").alias("max_len"))


@query(f"SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND p_partkey % 2 = 1 UNION ALL SELECT p_partkey FROM ({_NEW}) WHERE p_name LIKE '%ring'")
def maint_cleanup(spark, sf_dir):
    """Two deletions with an append between them; the cleanup comes where the bound is passed."""
    index, part = _own(spark, sf_dir), _table(spark, sf_dir, "part")
    index.delete(F.col("p_partkey") % 4 == 0)
    index.append(_additions(part))
    index.delete((F.col("p_partkey") % 4 == 2) & (F.col("p_partkey") < 100_000_000))
    return index.search([P("p_name", "LIKE", "%ring")]).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_name LIKE '%ring'")
def index_partial(spark, sf_dir):
    """An index over the filtered rows only."""
    part = _table(spark, sf_dir, "part").where("p_size > 10")
    return PatternIndex.build(part, _fresh(spark), ["p_name"]).search([P("p_name", "LIKE", "%ring")]).select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer WHERE c_name LIKE '%1' AND c_mktsegment = 'BUILDING'")
def index_text_partitions(spark, sf_dir):
    index = PartitionedIndex.build(_table(spark, sf_dir, "customer"), _fresh(spark), ["c_name"], "c_mktsegment")
    return index.search([P("c_name", "LIKE", "%1")], ["BUILDING"]).select("c_custkey")


@query("SELECT least(count(*), 10) AS n FROM part WHERE p_name LIKE '%r%'")
def limit_like(spark, sf_dir):
    """A bare LIMIT: which rows come is open, how many is not."""
    return search.search(_table(spark, sf_dir, "part"), [P("p_name", "LIKE", "%r%")], limit=10).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%' || substring(p_name, 2, 1) || '_' || '%'")
def column_pattern_escape(spark, sf_dir):
    """Patterns in a column, with escapes of plain characters."""
    pattern = F.concat(F.lit("%\\"), F.substring("p_name", 2, 1), F.lit("_%"))
    return _table(spark, sf_dir, "part").where(like("p_name", pattern)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring'")
def like_trailing_escape(spark, sf_dir):
    """A lone escape at the end, as a literal: in a text and in a column."""
    part = _table(spark, sf_dir, "part").withColumn("s", F.concat("p_name", F.lit("\\")))
    return part.where(like("s", "%ring\\", on_trailing_escape="literal") & like("s", F.lit("%ring\\"), on_trailing_escape="literal")).select("p_partkey")


@query("SELECT p_partkey, p_name LIKE '%r_n%' AS l, p_name NOT ILIKE 'S%' AS n, p_name LIKE '%' || substring(p_name, 1, 2) AS c FROM part")
def sql_predicates(spark, sf_dir):
    sql.register(spark)
    _table(spark, sf_dir, "part").createOrReplaceTempView("sieve_part")
    return spark.sql("SELECT p_partkey, sieve_like(p_name, '%r_n%') AS l, sieve_not_ilike(p_name, 'S%') AS n, sieve_like(p_name, concat('%', substring(p_name, 1, 2))) AS c FROM sieve_part")


@query("SELECT props, ts FROM events WHERE props LIKE '%6%' AND event_type ILIKE 'C%'")
def stream_like(spark, sf_dir):
    """Predicates on a stream that is read to its end."""
    events = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parq*")
    out = _fresh(spark)
    found = filters.matching(events, [P("props", "LIKE", "%6%"), P("event_type", "ILIKE", "C%")]).select("props", "ts")
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_name LIKE '%A%' AND n_regionkey IN (1, 2)")
def index_partitions(spark, sf_dir):
    index = PartitionedIndex.build(_table(spark, sf_dir, "nation"), _fresh(spark), ["n_name"], "n_regionkey")
    return index.search([P("n_name", "LIKE", "%A%")], [1, 2]).select("n_name", "n_regionkey")


# -- catalog --------------------------------------------------------------------------------------------------------

_OPS = ", ".join(f"('text_ops', {k}, '{catalog.SIGNS[k]}', 'text', 'text', '{name}')" for k, name in catalog.OPERATORS.items())
query(f"SELECT * FROM (VALUES {_OPS}) t(opfamily, strategy, operator, left_type, right_type, description)", "cat_operators")(lambda spark, sf_dir: catalog.operators(spark))
_HISTORY = ", ".join(f"('{v}', '{d}')" for v, d in catalog.HISTORY)
query(f"SELECT * FROM (VALUES {_HISTORY}) t(version, description)", "cat_version_history")(lambda spark, sf_dir: catalog.version_history(spark))
query(
    f"SELECT * FROM (VALUES ('Bitmap functions', true, 'Set algebra on row ids runs on built-in bitmaps'), ('Apache Spark', true, 'Running on Spark {catalog.spark_version()}')) t(feature, enabled, description)",
    "cat_build_info",
)(lambda spark, sf_dir: catalog.build_info(spark))


@query(f"SELECT '{catalog.VERSION}' AS version, true AS bitmaps_enabled, 'bitmap aggregates of Spark' AS bitmap_implementation, 1::BIGINT AS total_indexes")
def cat_status(spark, sf_dir):
    root = _fresh(spark)
    PatternIndex.build(_table(spark, sf_dir, "region"), f"{root}/region_names", ["r_name"])
    return catalog.Catalog(spark, root).status().drop("total_index_size")


@query("SELECT 'region_names' AS index_name, 1 AS num_columns, 'r_name' AS columns UNION ALL SELECT 'region_upper', 1, '(expression)' UNION ALL SELECT 'region_wide', 2, '2 columns'")
def cat_indexes(spark, sf_dir):
    root, region = _fresh(spark), _table(spark, sf_dir, "region")
    PatternIndex.build(region, f"{root}/region_names", ["r_name"])
    PatternIndex.build(region, f"{root}/region_upper", {"u": "upper(r_name)"})
    PatternIndex.build(region, f"{root}/region_wide", {"r_name": "r_name", "k": "cast(r_regionkey as string)"})
    return catalog.Catalog(spark, root).indexes().select("index_name", "num_columns", "columns")


_SIZES = (0, 1023, 1536, 5 << 20, 3 << 30, 12345678901)
_PRETTY = ", ".join(f"({n}, '{catalog.size_pretty(n)}')" for n in _SIZES)


@query(f"SELECT * FROM (VALUES {_PRETTY}) t(n, pretty)")
def cat_size_pretty(spark, sf_dir):
    sql.register(spark)
    return spark.createDataFrame([(n,) for n in _SIZES], "n long").selectExpr("n", "sieve_size_pretty(n) AS pretty")


@query("SELECT 'indexes' AS check_name, '1' AS status UNION ALL SELECT 'segments of an index, at most', '2' UNION ALL SELECT 'deleted rows still stored', '1' UNION ALL SELECT 'bitmap aggregates', 'present'")
def cat_check_config(spark, sf_dir):
    root, region = _fresh(spark), _table(spark, sf_dir, "region")
    index = PatternIndex.build(region, f"{root}/region_names", ["r_name"])
    index.append(region)
    index.delete((F.col("r_regionkey") == 0) & (F.col("rid") == 1))
    return catalog.Catalog(spark, root).check_config().where("check_name <> 'shared folder'").select("check_name", "status")


@query("SELECT 'region_names' AS index_name, 1 AS num_columns, 'PATTERN INDEX region_names (upper(r_name) AS u)' AS index_definition, true AS stored")
def cat_indexes_detailed(spark, sf_dir):
    root = _fresh(spark)
    PatternIndex.build(_table(spark, sf_dir, "region"), f"{root}/region_names", {"u": "upper(r_name)"})
    found = catalog.Catalog(spark, root)
    found.register_views()
    sizes = spark.table("sieve_memory_usage").select(F.col("index_name").alias("_i"), (F.col("bytes") > 0).alias("stored"))
    detailed = spark.table("sieve_indexes_detailed").select("index_name", "num_columns", "index_definition")
    return detailed.join(sizes, F.col("index_name") == F.col("_i")).drop("_i")


@query(f"SELECT '{catalog.VERSION}' AS version, true AS bitmaps_enabled")
def cat_build_info_json(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT from_json(sieve_build_info_json(), 'version STRING, bitmaps_enabled BOOLEAN') AS j").select("j.*")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
