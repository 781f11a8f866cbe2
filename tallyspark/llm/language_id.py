"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence about a page are brought together in log space: the likelihood of its visible text under
each language's character trigrams, the language that its markup declares, what its address says (a path segment
or a suffix), and the prior of its host. Host priors are hierarchical: the soft counts of the pages' posteriors
without the host's prior are summed by grouped aggregation for hosts, for their registered domains and overall,
and each level is smoothed towards the one above with a Dirichlet weight. A page's own counts are taken out of all
three levels before they are its prior, so that its evidence counts once.

The text model is fitted on a bounded sample of labelled documents (SAMPLE of each language, by a hash of their
ids, and at most LONGEST characters each) and keeps the sample's VOCABULARY most frequent trigrams; every page is
judged over its whole text. Per page only its host and one number for each language are moved.

Defined results: a null or empty page has no text evidence and is judged by address and prior; unknown or
contradictory declarations count as none; a null address has the empty host; markup that is never closed is text;
ties go to the first language in alphabetical order; repeated rows are pages each; without labelled documents there
are no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, map_slices, ship, table

SAMPLE = 400
LONGEST = 20_000
VOCABULARY = 20_000
#: Parts of a language's ids, each of which gives its own first ones.
SALTS = 16
#: How far declarations and addresses are believed: P(declared = l | language l).
DECLARED, ADDRESSED = 0.9, 0.8
#: Pages that a level's prior counts as, against the level below.
WEIGHT = 5.0
#: Trigrams of a text are not independent; their sum counts as at most so many.
EVIDENCE = 60.0
#: Hosts whose priors are broadcast at most (16 bytes a language and their names); more are joined by shuffle.
SMALL = 50_000
#: Second labels under which registrars of a country give out names.
SECOND = frozenset("ac co com edu gov net org".split())
_RAW = re.compile(r"<(script|style)\b[^>]*>", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_SPACE = re.compile(r"[\W\d_]+")


def visible(html: str | None) -> str:
    """The text outside of tags, comments, scripts and styles; one pass, whatever is left unclosed."""
    html, out, at = html or "", [], 0
    unclosed: set[str] = set()  # what no longer closes further on

    def ends(name: str, start: int) -> int:
        if name in unclosed:
            return -1
        if name == "comment":
            end = html.find("-->", start)
            end = end + 3 if end >= 0 else -1
        else:
            m = _CLOSE[name].search(html, start)
            end = m.end() if m else -1
        if end < 0:
            unclosed.add(name)
        return end

    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        close = html.find(">", start)
        if close < 0:
            at = start
            break
        end = -1
        if html.startswith("<!--", start):
            end = ends("comment", start + 4)
        elif m := _RAW.match(html, start):
            end = ends(m[1].lower(), m.end())
        at = end if end >= 0 else close + 1
        out.append(" ")
    return unescape("".join(out) + html[at:])


def declared_language(html: str | None) -> str | None:
    html, at = html or "", 0
    while m := _HTML.search(html, at):
        close = html.find(">", m.end())
        found = _LANG.search(html, m.end(), close if close >= 0 else len(html))
        if found:
            return found[1].lower()
        if close < 0:
            return None
        at = close
    return None


def trigrams(text: str) -> list[str]:
    t = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    return [t[k : k + 3] for k in range(len(t) - 2)]


def host_of(url: str | None) -> tuple[str, str, list[str]]:
    """Host, registered domain (its last two labels, or three under a country's second label) and the address's language candidates."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", "", []
    labels = host.split(".")
    known = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else 2
    domain = host if labels[-1].isdigit() else ".".join(labels[-known:])  # addresses in numbers have no domain
    return host, domain, [*(s.lower() for s in parts.path.split("/") if 2 <= len(s) <= 3), *labels[-1:], *labels[:1]]


class TextModel:
    """log P(trigram | language), with add-one smoothing over the trigrams of the sample."""

    def __init__(self, rows: list[tuple[str, str]], most: int = VOCABULARY):
        self.languages = sorted({lang for _, lang in rows})
        counts: dict[str, Counter] = {lang: Counter() for lang in self.languages}
        for text, lang in rows:
            counts[lang].update(trigrams(text))
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        self.index = {g: i for i, (g, _) in enumerate(sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:most])}
        n = np.ones((len(self.index) + 1, len(self.languages)))  # the last row: of trigrams unknown
        for j, lang in enumerate(self.languages):
            for g, c in counts[lang].items():
                n[self.index.get(g, len(self.index)), j] += c
        self.logs = np.log(n / n.sum(axis=0)) if len(self.languages) else n

    def text(self, text: str) -> np.ndarray:
        grams = trigrams(text)
        if not grams:
            return np.zeros(len(self.languages))
        none = len(self.index)
        get = self.index.get
        at = np.fromiter((get(g, none) for g in grams), np.int64, len(grams))
        total = self.logs[at].sum(axis=0)
        return total * min(1.0, EVIDENCE / len(grams))

    def hint(self, lang: str | None, belief: float) -> np.ndarray:
        k = len(self.languages)
        if lang not in self.languages or k < 2:
            return np.zeros(k)
        return np.log(np.where(np.array(self.languages) == lang, belief, (1 - belief) / (k - 1)))


def fit(docs: DataFrame, size: int = SAMPLE, longest: int = LONGEST) -> TextModel:
    """docs: doc_id, text, lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    # ids first, so that no more than the sample's texts move
    of = rows.where(F.col("doc_id").isNotNull()).select("lang", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    of = of.withColumn("h", F.xxhash64("doc_id"))
    for by in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):  # a language may hold most rows: the first of each salt, then of all
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        of = of.withColumn("rank", rank).where(F.col("rank") <= size)
    picked = [(r["doc_id"], r["lang"]) for r in of.collect()]
    if not picked:
        return TextModel([])
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, lang string")
    texts = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    out = [(r["text"], r["lang"]) for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["doc_id"]))]
    return TextModel(out)


def identify(pages: DataFrame, model: TextModel, weight: float = WEIGHT) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of each page (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    langs = model.languages
    if not langs:
        return spark.createDataFrame([], "page_id long, host string, declared string, text_lang string, lang string, confidence double")
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        hosts, domains, declared, by_text, logs, soft = [], [], [], [], [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host, domain, said = host_of(url)
            d = declared_language(html)
            own = m.text(visible(html))
            a = next((s for s in said if s in m.languages), None)
            total = own + m.hint(d, DECLARED) + m.hint(a, ADDRESSED)
            p = np.exp(total - total.max())
            hosts.append(host)
            domains.append(domain)
            declared.append(d)
            by_text.append(m.languages[int(own.argmax())] if own.any() else None)
            logs.append((total - total.max()).tolist())
            soft.append((p / p.sum()).tolist())
        kinds = [pa.string()] * 4 + [pa.list_(pa.float64())] * 2
        arrays = [pa.array(x, k) for x, k in zip((hosts, domains, declared, by_text, logs, soft), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["page_id", "host", "domain", "declared", "text_lang", "logs", "soft"])

    schema = "page_id long, host string, domain string, declared string, text_lang string, logs array<double>, soft array<double>"
    seen = cut(map_slices(pages.select(F.col("page_id").cast("long"), "url", "html"), run, schema, 256))
    k = len(langs)
    sums = F.array(*[F.sum(F.col("soft")[j]) for j in range(k)])
    top = seen.agg(sums.alias("sums")).collect()[0]["sums"]
    top = [x or 0.0 for x in top]
    whole = math.fsum(top)

    domains = seen.groupBy("domain").agg(sums.alias("of_domain"), F.count("*").alias("in_domain"))
    hosts = seen.groupBy("host", "domain").agg(sums.alias("of_host"), F.count("*").alias("in_host")).join(domains, "domain").drop("domain")
    hosts = cut(hosts)
    if hosts.count() <= SMALL:
        post = seen.join(F.broadcast(hosts), "host")
    else:  # a host may hold a third of all pages: its row goes to each of SALTS parts
        hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        post = seen.withColumn("salt", F.pmod(F.xxhash64("page_id", F.array_join(F.transform("logs", lambda x: x.cast("string")), " ")), F.lit(SALTS).cast("long"))).join(hosts, ["host", "salt"])

    def level(counts, n, above):
        """The other pages' soft counts, smoothed towards the level above."""
        others = F.zip_with(counts, "soft", lambda x, own: F.greatest(x - own, F.lit(0.0)))
        return F.zip_with(others, above, lambda x, p: (x + weight * p) / (n - 1 + weight))

    overall = F.zip_with(F.array(*map(F.lit, top)), "soft", lambda x, own: (F.greatest(x - own, F.lit(0.0)) + 1.0) / (whole - 1.0 + k))
    post = post.withColumn("p0", overall).withColumn("p1", level("of_domain", F.col("in_domain"), "p0")).withColumn("p2", level("of_host", F.col("in_host"), "p1"))
    post = post.withColumn("z", F.zip_with("logs", "p2", lambda a, b: a + F.log(b)))
    post = post.withColumn("best", F.array_max("z"))
    at = F.array_position("z", F.col("best")).cast("int")
    sure = 1.0 / F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best")))
    return post.select("page_id", "host", "declared", "text_lang", F.element_at(F.array(*map(F.lit, langs)), at).alias("lang"), sure.alias("confidence"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))


def accuracy(model: TextModel, rows: list[tuple[str, str]]) -> float:
    """Share of (text, lang) that the text evidence alone tells rightly."""
    right = [model.languages[int(model.text(t).argmax())] == lang for t, lang in rows]
    return math.fsum(right) / max(1, len(right))
