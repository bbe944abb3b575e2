"""Pages: list items, detail fields and block text. Parsing is per row; Spark deals the rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.views import table
from ..registry import query

BLOCKS = frozenset("article blockquote div footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tr ul".split())
HIDDEN = frozenset(("script", "style", "head"))
DOCUMENT = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar")


class _Blocks(HTMLParser):
    """Text blocks in page order: ``<br>`` breaks lines, cells are tabs apart, items of ordered
    lists are numbered, document links carry their url (K1 to K4)."""

    def __init__(self, base: str, container: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.container = base, container
        self.blocks, self.now, self.links = [], [], []
        self.hidden = 0
        self.inside = 0 if container else 1
        self.lists: list[list] = []
        self.href = None

    def flush(self):
        lines = [" ".join(x.split(" ")).strip() if "\t" not in x else x.strip("\n ") for x in "".join(self.now).split("\n")]
        if text := "\n".join(x for x in (" ".join(y.split()) if "\t" not in y else y for y in lines) if x):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if self.container and tag == self.container:
            self.inside += 1
        if tag in BLOCKS:
            self.flush()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists and self.lists[-1][0] == "ol":
            self.lists[-1][1] += 1
            self.now.append(f"{self.lists[-1][1]}. ")
        elif tag == "br":
            self.now.append("\n")
        elif tag in ("td", "th") and self.now:
            self.now.append("\t")
        elif tag == "img" and self.inside and not self.hidden:
            self.now.append(f"[image] {urljoin(self.base, dict(attrs).get('src') or '')} ")
        elif tag == "a":
            href = dict(attrs).get("href") or ""
            self.href = urljoin(self.base, href) if href.lower().split("?")[0].endswith(DOCUMENT) else None

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "a" and self.href:
            self.now.append(f" {self.href}")
            self.links.append(self.href)
            self.href = None
        if tag in BLOCKS:
            self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if self.container and tag == self.container:
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.now.append(data if "\t" not in data else data.replace("\t", " "))


def block_text(html: str | None, base: str = "", containers: tuple[str, ...] = ("article", "main", "body")) -> tuple[str, list[str]]:
    """Text of the first container that gives any (K6), and the document links in it (K5)."""
    for container in (*containers, None):
        parser = _Blocks(base or "", container)
        parser.feed(html or "")
        parser.close()
        parser.flush()
        if parser.blocks:
            return "\n\n".join(parser.blocks), list(dict.fromkeys(parser.links))
    return "", []


#: Types as objects: workers import this module, and text would need a session to be parsed.
PAGE_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(PAGE_TEXT)
def page_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for htmls, urls in batches:
        found = [block_text(h, u) for h, u in zip(htmls, urls, strict=True)]
        yield pd.DataFrame({"text": [t for t, _ in found], "links": [x for _, x in found]})


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute url of a link of any form."""
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href, strict=True)], dtype=object)


#: Encodings in the order of preference; Spark's own decode knows few of them.
ENCODINGS = ("utf-8-sig", "gb18030", "big5", "latin-1")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Text of bytes by the first encoding that fits."""

    def one(data):
        for e in ENCODINGS:
            try:
                return data.decode(e)
            except UnicodeDecodeError:
                continue

    return pd.Series([None if x is None else one(bytes(x)) for x in raw], dtype=object)


#: Words that right decodings of notices hold.
DOMAIN_WORDS = ("新闻", "传播", "学院", "通知", "公告", "学生", "关于", "工作", "活动")


def best_decoding(raw: Column, encodings: list[str], words=DOMAIN_WORDS) -> Column:
    """struct(encoding, text) of the decoding with the most domain words, then the most Chinese characters, then
    the fewest replacements, then the first in the list (A2, J19). Null bytes stay null.

    Python only decodes, with U+FFFD for what doesn't fit; the choice is an expression.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def every(raws: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [bytes(x).decode(e, "replace") for e in encodings] for x in raws], dtype=object)

    def judged(t, i):
        hits = sum(((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))
        chinese = F.length(t) - F.length(F.regexp_replace(t, "[\\x{4e00}-\\x{9fff}]", ""))
        lost = F.length(F.regexp_replace(t, "[^\\x{fffd}]", ""))
        return F.struct(hits.alias("hits"), chinese.alias("chinese"), (-lost).alias("lost"), (-i).alias("at"), t.alias("text"))

    best = F.transform(F.array(every(raw)), lambda ts: F.array_max(F.transform(ts, judged)))
    return F.element_at(F.transform(best, lambda b: F.when(b["text"].isNotNull(), F.struct(F.element_at(F.array(*map(F.lit, encodings)), 1 - b["at"]).alias("encoding"), b["text"].alias("text")))), 1)


@query(
    "A02_best_decoding",
    r"""WITH t AS (SELECT doc_id, lang, regexp_replace(text, '[^\x00-\xff]', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN lang IN ('fr', 'es') AND regexp_matches(t, '[^\x00-\x7f]') THEN 'latin-1' ELSE 'utf-8' END AS encoding, sha256(t) AS text_sha256 FROM t""",
)
def best_decoding_query(spark, d):
    """Documents of two languages as Latin-1 bytes, the others as UTF-8: each comes back right."""
    text = F.regexp_replace("text", r"[^\x00-\xff]", "")
    raw = F.when(F.col("lang").isin("fr", "es"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    found = table(spark, d, "documents").select("doc_id", best_decoding(raw, ["utf-8", "latin-1"], ("license",)).alias("b"))
    return found.select("doc_id", "b.encoding", F.sha2("b.text", 256).alias("text_sha256"))


def list_items(pages: DataFrame) -> DataFrame:
    """Links of list elements: page_id, at, href, title; those without a target go (A4)."""
    found = F.regexp_extract_all("html", F.lit('<li><a href="([^"]+)">[^<]*</a></li>'), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit('<li><a href="[^"]+">([^<]*)</a></li>'), F.lit(1))
    return pages.select("page_id", F.posexplode(F.arrays_zip(found.alias("href"), titles.alias("title"))).alias("at", "x")).select("page_id", F.col("at").cast("long"), "x.href", "x.title")


@query(
    "A03_list_page_urls",
    "SELECT n_nationkey, n AS page, CASE WHEN n > 1 THEN n_name || '/list' || n || '.htm' WHEN n_nationkey % 2 = 0 THEN n_name || '/list.htm' ELSE n_name || '/list1.htm' END AS url FROM nation, (SELECT unnest(range(1, 6)) AS n)",
)
def list_page_urls(spark, d, pages: int = 5):
    """Urls of each site's list pages; the first one's name is the site's own."""
    sites = table(spark, d, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(pages).cast("long"))).alias("page"))
    first = F.when(F.col("n_nationkey") % 2 == 0, "/list.htm").otherwise("/list1.htm")
    return sites.select("n_nationkey", "page", F.concat("n_name", F.when(F.col("page") == 1, first).otherwise(F.concat(F.lit("/list"), "page", F.lit(".htm")))).alias("url"))


@query(
    "A04_list_items",
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]+)">[^<]*</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]+">([^<]*)</a></li>', 1) AS t FROM pages)
       SELECT page_id, i - 1 AS at, h[i] AS href, t[i] AS title FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)""",
)
def list_items_query(spark, d):
    return list_items(table(spark, d, "pages"))


@query("A05_detail_fields", "SELECT page_id, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') AS lang, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS source FROM pages")
def detail_fields(spark, d):
    """Title, language and source of a detail page."""
    first = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", first("<h1>([^<]*)</h1>").alias("title"), first('lang="([a-z]+)"').alias("lang"), F.try_parse_url(F.col("url"), F.lit("HOST")).alias("source"))


@query("K01_block_text")
def block_text_query(spark, d):
    """Article text in blocks (K1 to K6, K8). Parsing has no SQL form; tests hold it against fixtures."""
    return table(spark, d, "pages").withColumn("p", page_text("html", "url")).select("page_id", "p.text", F.size("p.links").alias("links"))
