"""Checked queries for signature parsing and parameter schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signature as S
from ..operators import schema as SC
from .registry import query, table

# Signature shapes rendered from lineitem columns; the shape is chosen by the
# line number so every shape occurs at every scale.
_SIG_SQL = """
CASE l_linenumber % 5
  WHEN 0 THEN '(self, a: ''int'' = ' || l_linenumber || ', b=''' || l_returnflag || ''', c: dict[str, int] = None, *args, d=' || l_discount || ', **kw) -> list[int]'
  WHEN 1 THEN '(x, shape=(0, ' || l_linenumber || '), /)'
  WHEN 2 THEN '(self, k: ''str | None'' = None, path: os.PathLike[str] = ''' || l_linestatus || ''', flag: ''bool'' = False, n=-' || l_linenumber || ')'
  WHEN 3 THEN '(e: int | float | None = ' || l_quantity || ', f: ''Tuple[int, int]'' = (1, 2), g=1-' || l_linenumber || ', h=' || l_tax || ')'
  ELSE '()'
END"""


def _signatures(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.expr(_SIG_SQL).alias("signature"))


@query("parse_signature", f"""
WITH rows AS (SELECT l_orderkey, l_linenumber, {_SIG_SQL} AS signature FROM lineitem),
sigs AS (SELECT DISTINCT signature AS l_orderkey, 0 AS l_linenumber, signature FROM rows),
ps AS (
  SELECT l_orderkey, l_linenumber,
         regexp_extract_all(split_part(trim(signature, '()'), ') ->', 1), '(?:[^,\\[]|\\[[^\\]]*\\])+') AS ps
  FROM sigs),
pos AS (SELECT l_orderkey, l_linenumber, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM ps),
split AS (
  SELECT l_orderkey, l_linenumber, pos,
         CASE WHEN strpos(p, '=') > 0 THEN trim(substr(p, 1, strpos(p, '=') - 1)) ELSE trim(p) END AS nt,
         CASE WHEN strpos(p, '=') > 0 THEN trim(substr(p, strpos(p, '=') + 1)) END AS d
  FROM pos),
named AS (
  SELECT *, CASE WHEN strpos(nt, ':') > 0 THEN trim(substr(nt, 1, strpos(nt, ':') - 1)) ELSE nt END AS name,
            CASE WHEN strpos(nt, ':') > 0 THEN trim(trim(substr(nt, strpos(nt, ':') + 1)), '''') END AS ann
  FROM split),
typed AS (
  SELECT *,
    CASE WHEN d IS NULL THEN NULL
         WHEN lower(d) = 'none' THEN 'null'
         WHEN d IN ('True', 'False') THEN 'bool'
         WHEN starts_with(d, '''') OR starts_with(d, '"') THEN 'str'
         WHEN regexp_full_match(replace(d, '-', ''), '[0-9]+') THEN CASE WHEN TRY_CAST(d AS BIGINT) IS NOT NULL THEN 'int' ELSE 'raw' END
         WHEN regexp_full_match(replace(replace(d, '.', ''), '-', ''), '[0-9]+') THEN CASE WHEN TRY_CAST(d AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'raw' END
         ELSE 'raw' END AS dkind
  FROM named WHERE NOT (starts_with(name, '*') OR name = '' OR name = 'self')),
rendered AS (
  SELECT *,
    CASE dkind WHEN 'null' THEN 'null' WHEN 'bool' THEN lower(d)
               WHEN 'str' THEN to_json(trim(d, '''"'))::VARCHAR
               WHEN 'int' THEN CAST(CAST(d AS BIGINT) AS VARCHAR)
               WHEN 'float' THEN CAST(CAST(d AS DOUBLE) AS VARCHAR)
               WHEN 'raw' THEN to_json(d)::VARCHAR END AS djson,
    CASE WHEN ann IS NOT NULL AND ann <> '' THEN
           CASE WHEN strpos(ann, '|') > 0 THEN
                  list_sort(list_distinct(list_transform(string_split(ann, '|'),
                     lambda t: CASE WHEN lower(trim(t)) = 'none' THEN 'null'
                               WHEN starts_with(lower(trim(t)), 'os.pathlike') THEN 'string'
                               ELSE lower(trim(t)) END)))
                WHEN starts_with(lower(ann), 'os.pathlike') THEN ['string']
                ELSE [lower(ann)] END
         WHEN dkind IS NOT NULL THEN
           [CASE dkind WHEN 'null' THEN 'NoneType' WHEN 'bool' THEN 'bool' WHEN 'int' THEN 'int'
                       WHEN 'float' THEN 'float' ELSE 'str' END]
    END AS types
  FROM typed),
props AS (
  SELECT l_orderkey, l_linenumber, pos,
    to_json(name)::VARCHAR || ': {{' || concat_ws(', ',
       CASE WHEN types IS NOT NULL THEN '"type": ' ||
         CASE WHEN len(types) > 1 THEN '[' || array_to_string(list_transform(types, lambda t: to_json(
                CASE t WHEN 'none' THEN 'null' WHEN 'true' THEN 'boolean' WHEN 'false' THEN 'boolean'
                       WHEN 'int' THEN 'integer' ELSE t END)::VARCHAR), ', ') || ']'
              ELSE to_json(CASE types[1] WHEN 'none' THEN 'null' WHEN 'true' THEN 'boolean'
                       WHEN 'false' THEN 'boolean' WHEN 'int' THEN 'integer' ELSE types[1] END)::VARCHAR END
       END,
       CASE WHEN djson IS NOT NULL THEN '"default": ' || djson END) || '}}' AS prop
  FROM rendered)
SELECT r.l_orderkey, r.l_linenumber, r.signature, j.parameters_json FROM rows r JOIN (
  SELECT s.signature,
       '{{"type": "object", "properties": {{' || coalesce(string_agg(p.prop, ', ' ORDER BY p.pos), '') || '}}}}' AS parameters_json
  FROM sigs s LEFT JOIN props p ON s.l_orderkey = p.l_orderkey AND s.l_linenumber = p.l_linenumber
  GROUP BY s.signature) j ON r.signature = j.signature
""")
def q_parse_signature(spark, sf):
    return SC.with_parameter_schema(_signatures(spark, sf), "signature")


@query("schema_json", f"""
WITH n AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN 'constant' ELSE 'callable' END AS type,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN NULL ELSE {_SIG_SQL} END AS signature
  FROM lineitem)
SELECT l_orderkey, l_linenumber, type,
       CASE WHEN type = 'constant' THEN '{{"type": "constant"}}'
            WHEN signature IS NULL THEN NULL
            ELSE 'sig' END AS schema_kind
FROM n
""")
def q_schema_json(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_returnflag") == "R", "constant").otherwise("callable").alias("type"),
                  F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), F.lit(None))
                   .otherwise(F.expr(_SIG_SQL)).alias("signature"))
    js = S.schema_json(F.col("type"), F.col("signature"))
    return n.select("l_orderkey", "l_linenumber", "type",
                    F.when(F.startswith(js, F.lit('{"type": "object"')), F.lit("sig")).otherwise(js)
                    .alias("schema_kind"))
