"""Fill-in-the-middle documents by DuckDB's SQL inside ``mapInArrow``.

Spark deals the rows; in a task each Arrow batch is registered as a table of an in-process DuckDB, one SQL statement turns it
into the result, and that leaves as Arrow: no row passes through Python.  Batches are bounded by bytes, DuckDB runs one thread
in each task.

A text is cut into units: runs of A-Z and a-z, and any other character alone.  Cuts and form hang on sha256 of ``1:`` and the
id alone, so they are the same wherever and however often a row is computed.  The prefix ends after the smaller of two cuts,
the middle after the larger.  Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle), ``plain`` (the text).

``restore`` gives the text back from output and form alone.  A text that holds a marker stays plain, and no marker can arise
where parts meet, since a marker begins with its only ``<`` and ends with its only ``>``.

Defined cases: a null text is as an empty one, and plain; a null id is as the empty text after ``1:``; texts of any length are
transformed whole (a task holds the units of one batch); repeated rows give repeated rows; an empty table gives an empty
table; other columns are kept by ``transform`` and ``restore``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the task: markers, shares of documents that change and of those that take the suffix first, and the hash's seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED_OF_100, SUFFIX_FIRST_OF_100, SEED = 90, 20, "1"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of texts that one SQL statement looks at, if a batch has more; a longer text is alone.
STEP_BYTES = 4 << 20

TRANSFORM = f"""
WITH hashed AS (
  SELECT k, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(id::VARCHAR, '')) AS h FROM rows_),
numbers AS (
  SELECT k, text, [('0x' || substr(h, 8 * i + 1, 8))::UBIGINT FOR i IN [0, 1, 2, 3]] AS h,
         regexp_extract_all(text, '{UNIT}') AS units FROM hashed),
cuts AS (
  SELECT k, text, h, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= {CHANGED_OF_100} THEN 'plain'
              WHEN h[4] % 100 < {SUFFIX_FIRST_OF_100} THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT k, text, n, form, array_to_string(list_slice(units, 1, a), '') AS p, array_to_string(list_slice(units, a + 1, b), '') AS m, array_to_string(list_slice(units, b + 1, n), '') AS s FROM cuts)
SELECT n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m) ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END AS output
FROM parts ORDER BY k
"""

#: Between the markers: where each is, and what stands between them.
RESTORE = f"""
WITH found AS (
  SELECT k, coalesce(output, '') AS output, form, strpos(output, CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS second, strpos(output, '{MIDDLE}') AS third FROM rows_),
parts AS (
  SELECT k, output, form, substr(output, 4, second - 4) AS one, substr(output, second + 3, third - second - 3) AS two, substr(output, third + 3) AS m FROM found)
SELECT CASE form WHEN 'psm' THEN concat(one, m, two) WHEN 'spm' THEN concat(two, m, one) ELSE output END AS restored FROM parts ORDER BY k
"""


def _steps(b: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP_BYTES of texts."""
    at = common.utf8(b.column(place))[1]
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(at.searchsorted(at[lo] + STEP_BYTES, "right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def _by_sql(df: DataFrame, sql: str, takes: dict[str, str], gives: str) -> DataFrame:
    """df with the columns that one SQL statement makes of each batch; ``takes``: name in the SQL to column, the first is the text."""
    common.arrow_bytes(df.sparkSession)
    columns = {name: df.columns.index(c) for name, c in takes.items()}
    schema = df.sparkSession.createDataFrame([], gives).schema
    clash = {c.lower() for c in df.columns} & {f.name.lower() for f in schema}
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        try:
            for whole in common.batches(rows):
                for b in _steps(whole, next(iter(columns.values()))):
                    con.register("rows_", pa.table({"k": pa.array(range(b.num_rows), pa.int64())} | {name: b.column(c) for name, c in columns.items()}))
                    out = con.execute(sql).to_arrow_table().combine_chunks()
                    con.unregister("rows_")
                    yield pa.RecordBatch.from_arrays([*b.columns, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns)], [*b.schema.names, *out.schema.names])
        finally:
            con.close()

    for f in schema:
        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.drop(*schema.names).mapInArrow(run, df.schema)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output."""
    return _by_sql(docs, TRANSFORM, {"text": text_col, "id": id_col}, "n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """rows with the exact text in ``restored``, from output and form alone."""
    return _by_sql(rows, RESTORE, {"output": output_col, "form": form_col}, "restored string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars and sha256 of output and of the text restored from it."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = transform(docs).drop("text")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The contract's rows, by whole-table SQL that cuts texts by character counts.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4,
             regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
f AS (SELECT doc_id, t, len(u) AS n, h3, h4, [length(x) FOR x IN u] AS sizes, h1 % (len(u) + 1) AS x, h2 % (len(u) + 1) AS y FROM e),
g AS (SELECT doc_id, t, n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(list_sum(sizes[1:least(x, y)]), 0)::BIGINT AS p, coalesce(list_sum(sizes[1:greatest(x, y)]), 0)::BIGINT AS q FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
             ELSE '<S>' || substr(t, q + 1) || '<P>' || left(t, p) || '<M>' || substr(t, p + 1, q - p) END AS output FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
