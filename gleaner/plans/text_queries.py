"""Queries of the text functions and word windows."""

from pyspark.sql import functions as F

from gleaner.functions import html
from gleaner.functions import text as T
from gleaner.operators import chunk
from gleaner.plans import duck
from gleaner.plans.registry import query, table


@query(f"SELECT doc_id, {duck.norm('text')} AS normalized FROM documents")
def normalize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {duck.norm_iaa('text')} AS normalized FROM documents")
def normalize_iaa(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_iaa(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, len({duck.words('text')}) AS n_words, array_to_string({duck.words('text')}, '|') AS words FROM documents")
def tokenize(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "|").alias("words"))


@query(f"WITH t AS (SELECT doc_id, {duck.collapse('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 140 THEN substr(t, 1, 137) || '...' ELSE t END AS short FROM t")
def short_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short(F.col("text")).alias("short"))


_CHUNKS = """SELECT {key}, CAST(i AS BIGINT) AS chunk_id, array_to_string(w[i * 110 + 1 : i * 110 + 150], ' ') AS chunk
FROM (SELECT {key}, w, unnest(range(1 + CAST(ceil(greatest(len(w) - 150, 0) / 110.0) AS BIGINT))) AS i FROM t WHERE len(w) > 0)"""


@query(f"WITH t AS (SELECT doc_id, {duck.words('text')} AS w FROM documents) " + _CHUNKS.format(key="doc_id"))
def chunk_docs(spark, d):
    rows = chunk.chunk_table(table(spark, d, "documents"), "doc_id", F.col("text"))
    return rows.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk")


@query("""SELECT conv_id, turn, CASE WHEN t = '' THEN 'UNKNOWN' ELSE substr(trim(string_split(t, chr(10))[1]), 1, 80) END AS answer, trim(replace(coalesce(text, ''), chr(10), ' ')) AS line
FROM (SELECT *, trim(text, ' ' || chr(10)) AS t FROM conversations)""")
def answer_clean(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_answer(text).alias("answer"), T.one_line(text).alias("line"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split(CASE WHEN g = '' THEN t ELSE replace(t, g, '<mark>' || g || '</mark>') END, chr(10)), lambda p: trim(p) <> ''), '|') AS marked
FROM (SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') AS t, role AS g FROM conversations)""")
def highlight_span(spark, d):
    marked = F.array_join(T.highlight(F.col("text"), F.col("role")), "|")
    return table(spark, d, "conversations").select("conv_id", "turn", marked.alias("marked"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN NULL WHEN 4 THEN 0 WHEN 5 THEN NULL ELSE 1 END AS valid FROM documents""")
def parse_validity(spark, d):
    written = F.element_at(F.array(*map(F.lit, (" Valid ", "supported", "0", "maybe", "No", None, "TRUE"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.parse_validity(written).alias("valid"))


_STR = duck.strip
_PAGE_TEXT = r"""WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<nav\b.*?</nav\s*>', '', 'g'),
 '(?is)<footer\b.*?</footer\s*>', '', 'g'), '(?is)<header\b.*?</header\s*>', '', 'g'), '(?is)<noscript\b.*?</noscript\s*>', '', 'g') AS k FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_extract(k, '(?is)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]*>', chr(10), 'g') AS m FROM a),
c AS (SELECT page_id, html, replace(replace(replace(replace(m, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS m FROM b),
t AS (SELECT page_id, html, array_to_string(list_filter(list_transform(string_split(m, chr(10)), lambda x: """ + _STR("x") + """), lambda x: x <> ''), chr(10)) AS text FROM c)
"""


_TITLE = _STR("replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')")


@query(_PAGE_TEXT + f", i AS (SELECT page_id, text, {_TITLE} AS title FROM t), f AS (SELECT page_id, CASE WHEN title <> '' THEN title || chr(10) || text ELSE text END AS text FROM i), w AS (SELECT page_id, {duck.words('text')} AS w FROM f) " + _CHUNKS.format(key="page_id").replace("FROM t WHERE", "FROM w WHERE"))
def chunk_pages(spark, d):
    """Title and text of every page in windows of words."""
    pages = table(spark, d, "pages").select("page_id", chunk.full_text(html.plain_title(F.col("html")), html.plain_text(F.col("html"))).alias("text"))
    rows = chunk.chunk_table(pages, "page_id", F.col("text"))
    return rows.select("page_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk")


@query(_PAGE_TEXT + f"SELECT page_id, {_TITLE} AS title, text FROM t")
def html_text_v1(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text_v1(F.col("html")).alias("t")).select("page_id", "t.*")


@query(_PAGE_TEXT + "SELECT page_id, text FROM t")
def html_text_native(spark, d):
    return table(spark, d, "pages").select("page_id", html.plain_text(F.col("html")).alias("text"))


@query()
def html_text_v2(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text_v2(F.col("html")).alias("t")).select("page_id", "t.*")


@query("SELECT page_id, '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' |  |' AS table_md FROM pages")
def html_table_md(spark, d):
    made = F.concat(F.lit("<table><tr><th>A</th><th>B</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    return table(spark, d, "pages").select("page_id", F.get(html.html_tables(made), F.lit(0)).alias("table_md"))


@query(_PAGE_TEXT + "SELECT page_id, length(text) AS n FROM t WHERE length(text) >= 100")
def page_min_len(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.length(html.plain_text(F.col("html"))).cast("long").alias("n"))
    return rows.where("n >= 100")


@query(_PAGE_TEXT + "SELECT page_id, length(text) / length(html) < 0.005 AS low_ratio FROM t")
def text_ratio(spark, d):
    return table(spark, d, "pages").select("page_id", (F.length(html.plain_text(F.col("html"))) / F.length("html") < 0.005).alias("low_ratio"))
