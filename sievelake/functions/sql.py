"""The predicates and the catalog's functions under names that SQL can call. All are SQL functions of Spark: no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sievelake.sources import catalog

#: A column of patterns in normal form (see ``predicate.normal_form``): every escaped character literal, a lone escape at the end too.
_NORMAL = r"""array_join(transform(regexp_extract_all(p, r'(?s)\\.|.', 0), t -> CASE
  WHEN length(t) = 2 THEN CASE WHEN substring(t, 2, 1) IN ('%', '_', r'\') THEN t ELSE substring(t, 2, 1) END
  WHEN t = r'\' THEN r'\\' ELSE t END), '')"""
_UNITS = "CASE WHEN n < 1024 THEN concat(n, ' bytes') " + " ".join(
    f"WHEN n < {scale << 10} THEN concat(cast(n / {scale}BD AS DECIMAL(30, 2)), ' {unit} (', n, ' bytes)')" for unit, scale in (("KB", 1 << 10), ("MB", 1 << 20))
) + f" ELSE concat(cast(n / {1 << 30}BD AS DECIMAL(30, 2)), ' GB (', n, ' bytes)') END"


def functions(spark: SparkSession) -> dict[str, str]:
    """Definitions by name: what follows CREATE TEMPORARY FUNCTION <name>."""
    both = "(v STRING, p STRING) RETURNS BOOLEAN RETURN "
    like, ilike = f"v LIKE {_NORMAL}", f"lower(v) LIKE lower({_NORMAL})"
    info = ", ".join(f"('{r['feature']}', {str(r['enabled']).lower()}, '{r['description']}')" for r in catalog.build_info(spark).collect())
    signs = ", ".join(f"({k}, '{catalog.SIGNS[k]}', '{name}')" for k, name in catalog.OPERATORS.items())
    return {
        "sieve_like": both + like,
        "sieve_not_like": f"{both} NOT ({like})",
        "sieve_ilike": both + ilike,
        "sieve_not_ilike": f"{both} NOT ({ilike})",
        "sieve_version": f"() RETURNS STRING RETURN '{catalog.VERSION}'",
        "sieve_size_pretty": f"(n BIGINT) RETURNS STRING RETURN {_UNITS}",
        "sieve_build_info_json": f"() RETURNS STRING RETURN '{catalog.build_info_json(spark)}'",
        "sieve_build_info": f"() RETURNS TABLE (feature STRING, enabled BOOLEAN, description STRING) RETURN SELECT * FROM VALUES {info}",
        "sieve_operators": f"() RETURNS TABLE (strategy INT, operator STRING, description STRING) RETURN SELECT * FROM VALUES {signs}",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names."""
    found = functions(spark)
    for name, definition in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
    return list(found)
