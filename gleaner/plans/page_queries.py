"""Queries over pages and their URLs."""

from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.operators import crawl
from gleaner.plans.registry import query, table
from gleaner.sources import readers, sinks
from gleaner.sources.folders import work_dir

_HOST = r"(?:[a-z0-9.-]+\.)?example\.org"
_CLEAN = "string_split(string_split({}, '#')[1], '?')[1]"


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def scan_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query(f"SELECT page_id, string_split(url, '#')[1] AS bare, regexp_replace({_CLEAN.format('url')}, '^http://', 'https://') AS clean FROM pages")
def url_clean(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.without_fragment(u).alias("bare"), urls.https(urls.clean(u)).alias("clean"))


@query(rf"""SELECT page_id, regexp_matches({_CLEAN.format('url')}, '^https?://{_HOST}') AND NOT regexp_matches(lower({_CLEAN.format('url')}), '\.(pdf|jpg|jpeg|png|gif|zip|mp4|svg|ico)$') AS prefix,
regexp_matches({_CLEAN.format('url')}, '^https?://{_HOST}(/|$)') AND NOT regexp_matches(lower({_CLEAN.format('url')}), '\.(pdf|jpg|jpeg|png|gif|zip|mp4|svg|ico)$') AS strict FROM pages""")
def url_allowed(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.allowed(u, _HOST).alias("prefix"), urls.allowed(u, _HOST, True).alias("strict"))


@query("""WITH k AS (SELECT page_id, unnest([regexp_replace(url, '^https://', 'http://'), regexp_replace(url, '^http://', 'https://')]) AS alias FROM pages),
l AS (SELECT alias, max(page_id) AS found FROM k GROUP BY 1)
SELECT page_id, found FROM pages LEFT JOIN l ON l.alias = regexp_replace(url, '^https://', 'http://')""")
def url_lookup(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    keys = pages.select("page_id", F.explode(F.array_distinct(urls.aliases(F.col("url")))).alias("alias")).groupBy("alias").agg(F.max("page_id").alias("found"))
    asked = pages.withColumn("alias", F.regexp_replace("url", "^https://", "http://"))
    return asked.join(keys, "alias", "left").select("page_id", "found")


_LINKS = r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
r AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
 WHEN href LIKE '//%' THEN string_split(url, ':')[1] || ':' || href WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
 ELSE string_split(string_split(url, '#')[1], '?')[1] || href END AS target FROM h WHERE href LIKE '/%' OR href LIKE '#%' OR href LIKE '?%' OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:')),
l AS (SELECT DISTINCT page_id, regexp_replace(string_split(string_split(target, '#')[1], '?')[1], '^http://', 'https://') AS link FROM r)
"""
_ALLOWED = rf"regexp_matches(link, '^https?://{_HOST}') AND NOT regexp_matches(lower(link), '^[a-z]+://[^/]*/.*\.(pdf|jpg|jpeg|png|gif|zip|mp4|svg|ico)$')"
_KEYED = "k AS (SELECT page_id, regexp_replace(string_split(string_split(url, '#')[1], '?')[1], '^http://', 'https://') AS url FROM pages)"


@query(_LINKS + "SELECT page_id, link FROM l")
def extract_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(urls.links(F.col("url"), F.col("html"))).alias("link"))


@query(_LINKS + f"SELECT page_id, link FROM l WHERE {_ALLOWED}")
def allowed_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(urls.links(F.col("url"), F.col("html"), _HOST)).alias("link"))


@query(_LINKS + ", " + _KEYED + " SELECT DISTINCT link AS url FROM l WHERE link NOT IN (SELECT url FROM k)")
def frontier_step(spark, d):
    """All pages are fetched and visited: what their links lead to besides."""
    pages = table(spark, d, "pages")
    return crawl.step(pages, crawl.keyed(pages).select("url"))


def _seeds(spark, d):
    return table(spark, d, "pages").orderBy("page_id").limit(1).select("url")


_CRAWL = _LINKS.replace("WITH h", "WITH RECURSIVE h") + ", " + _KEYED + """, e AS (SELECT DISTINCT k.url AS a, link AS b FROM l JOIN k USING (page_id)),
s AS (SELECT url FROM k ORDER BY page_id LIMIT 1),
v(url, depth) AS (SELECT url, 0 FROM s UNION SELECT b, depth + 1 FROM v JOIN e ON a = v.url WHERE depth < 3 AND EXISTS (SELECT 1 FROM k WHERE k.url = v.url)),
w AS (SELECT url, min(depth) AS depth FROM v GROUP BY 1)
"""


@query(_CRAWL + "SELECT page_id, k.url, CAST(depth AS BIGINT) AS depth FROM w JOIN k USING (url)")
def crawl_rounds(spark, d):
    """Four rounds from the first page, stopped after two and taken up again; the depth is the round's number."""
    state, pages = work_dir(spark, "crawl"), table(spark, d, "pages")
    crawl.crawl(_seeds(spark, d), pages, 2, state)
    got = crawl.crawl(_seeds(spark, d), pages, 4, state, resume=True)
    depth = spark.read.parquet(f"{state}/round=*/frontier").select("url", F.col("depth").cast("long").alias("depth"))
    return got.join(depth, "url").select("page_id", "url", "depth")


@query(_LINKS + ", " + _KEYED + ", f AS (SELECT link AS url, min(page_id) AS pos FROM l GROUP BY 1) SELECT f.url, pos, k.url IS NOT NULL AS recovered FROM f LEFT JOIN (SELECT DISTINCT url FROM k) k USING (url)")
def second_chance(spark, d):
    """Every link as a failed URL that is tried once more."""
    pages = table(spark, d, "pages")
    failed = pages.select(F.explode(urls.links(F.col("url"), F.col("html"))).alias("url"), F.col("page_id").alias("pos"))
    found, lost = crawl.second_chance(failed, pages)
    first = failed.groupBy("url").agg(F.min("pos").alias("pos"))
    return first.join(found.select("url").distinct(), "url", "left_semi").withColumn("recovered", F.lit(True)).unionByName(lost.withColumn("recovered", F.lit(False)))


_ANSWERED = "SELECT page_id, CASE length(html) % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status, CASE WHEN length(url) % 2 = 0 THEN 'Text/HTML; charset=utf-8' ELSE 'application/pdf' END AS kind FROM pages"


@query(f"SELECT page_id, coalesce(status = 200 AND kind LIKE 'Text/HTML%', false) AS is_page FROM ({_ANSWERED})")
def fetched_pages(spark, d):
    status = F.when(F.length("html") % 3 == 0, 200).when(F.length("html") % 3 == 1, 404)
    kind = F.when(F.length("url") % 2 == 0, "Text/HTML; charset=utf-8").otherwise("application/pdf")
    return table(spark, d, "pages").select("page_id", crawl.is_page(status, kind).alias("is_page"))


@query("SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS idx, coalesce(lag(page_id) OVER (ORDER BY page_id), page_id) AS before, coalesce(lead(page_id) OVER (ORDER BY page_id), page_id) AS after FROM pages")
def beside(spark, d):
    return readers.beside(table(spark, d, "pages").select("page_id"), "page_id")


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def list_head(spark, d):
    return readers.head(table(spark, d, "pages").select("page_id", "url"), "page_id")


@query("SELECT page_id, url FROM pages")
def pages_roundtrip(spark, d):
    """Written as JSON and as a table that is rewritten in place, and read again."""
    folder, pages = work_dir(spark, "pages"), table(spark, d, "pages").select("page_id", "url")
    sinks.replace(pages.limit(0), f"{folder}/table")
    sinks.replace(pages, f"{folder}/table")
    sinks.pages(spark.read.parquet(f"{folder}/table"), f"{folder}/json")
    return spark.read.schema("page_id long, url string").json(f"{folder}/json")
