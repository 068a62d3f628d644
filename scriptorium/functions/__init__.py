"""Column functions, and their registration under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the Arrow functions callable from SQL."""
    from pyspark.sql import functions as F

    from scriptorium.functions import bibtex, folding, html, similarity

    named = {
        "nfkd_fold": (folding._strip, "string"),
        "seq_ratio": (similarity._ratios, "double"),
        "token_set_ratio": (similarity._token_sets, "double"),
        "bib_parse": (bibtex._entries, bibtex.ENTRY),
        "html_parse": (html._parsed, html.PARSED),
        "html_extract": (html._documents, html.DOCUMENT),
    }
    for name, (function, kind) in named.items():
        spark.udf.register(name, F.pandas_udf(function, kind))
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)


#: Functions of SQL text, which the optimizer writes out where they are called. Links of pages are ``SELECT p.path, l.* FROM
#: (SELECT path, links_of(body) AS links FROM pages) AS p, LATERAL inline(p.links) AS l(line, target)``: a generator, no join.
_LINK = r"r'\[\[([^\]|]+)(?:\|[^\]]+)?\]\]'"
_EDGES = r"r'(?U)^\s+|\s+$'"
_LINE_ENDS = r"r'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]'"
SQL_FUNCTIONS = (
    f"CREATE OR REPLACE TEMPORARY FUNCTION link_targets(text STRING) RETURNS ARRAY<STRING> RETURN transform(regexp_extract_all(text, {_LINK}, 1), t -> regexp_replace(t, {_EDGES}, ''))",
    f"CREATE OR REPLACE TEMPORARY FUNCTION links_of(body STRING) RETURNS ARRAY<STRUCT<line: INT, target: STRING>> RETURN flatten(transform(split(body, {_LINE_ENDS}), "
    f"(text, at) -> transform(regexp_extract_all(text, {_LINK}, 1), t -> named_struct('line', at + 1, 'target', regexp_replace(t, {_EDGES}, '')))))",
)
