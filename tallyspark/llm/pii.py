"""Information-theoretic sanitisation of personal data.

Four patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Around each mention
stand terms that may give the entity away even when it is masked. How much a term t tells of an entity e is
estimated from the whole corpus: with n(t, e) the number of distinct contexts of e in which t stands and n(t) that
number and the times t occurs in distinct texts outside of e's contexts, P(e | t) = (n(t, e) + PRIOR P(e)) / (n(t) + PRIOR), and the pointwise information
log2(P(e | t) / P(e)) is compared with the entity's own information -log2 P(e). A term is disclosing if their
ratio exceeds DISCLOSURE. The prior draws the estimate towards P(e) where little is known of a term, so that
entities in one or two contexts count too. In every text that mentions the entity a disclosing term goes, wherever
it stands: it is removed if P(e | t) is at least REMOVE, else generalised to the longest of its beginnings of LETTERS
letters or fewer whose class - all terms of the corpus that begin so - discloses no more than the threshold; if there is none, removed.

Contexts are the WIDTH terms on each side of a mention, however far they stand, and are counted once for all copies
of a passage; a copied text's terms count once for all its copies, so that copies make no term more disclosing nor
less. Mentions have at most 2 WIDTH terms, so the pairs that are counted grow with the mentions, not with their
square. Of a text's terms further away only those that some entity's list may hold are paired with its entities: a
filter of FILTER bits, the same size for any corpus, tells which; what it lets through by chance is joined away.

Defined results: a null text counts as empty, has no spans and stays null when masked; kinds are matched
independently and may overlap; masking merges overlapping spans and names the first; repeated rows are treated
alike; rows without an id are scanned and masked like others.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, map_slices, releasing, ship, table

KINDS = ("email", "ip", "card", "phone")
#: Terms on each side of a mention that make its context.
WIDTH = 8
#: Weight of P(entity) in P(entity | term), in occurrences: a term in one context alone is generalised, in two removed.
PRIOR = 2.0
#: Share of an entity's information above which a term discloses it, and P(entity | term) from which it is removed.
DISCLOSURE = 0.85
REMOVE = 0.5
#: Texts with disclosing terms that are broadcast at most (a few hundred bytes each); more are joined by shuffle.
SMALL = 50_000
#: Hashes of copied texts that are broadcast at most (16 bytes each); more are joined by shuffle.
COPIED = 1_000_000
#: Beginnings of disclosing terms that are broadcast at most (some 20 bytes each); more are joined by shuffle.
BEGINS = 500_000
#: Letters of a generalised term at most, so that a word of n letters has no n beginnings of up to n letters.
LETTERS = 64
#: Bits of the filter of disclosing terms, which is sent to all executors.
FILTER = 1 << 20
#: Terms that a task counts before it hands on what it has.
TERMS = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[^0-9]")
_SEEN = ["kind", "entity", "term", "mark", "n"]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As leftmost matches of the whole pattern, but found from the @, so that long words cost no more than their length."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at)  # nothing before this @ can end at a later one
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind as in KINDS, then by start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """What mentions of one entity have in common."""
    return f"email:{value.lower()}" if kind == "email" else f"{kind}:{value}" if kind == "ip" else f"{kind}:{_DIGITS.sub('', value)}"


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[bool]]:
    """Start and end of each term of the text, and whether it is outside of all spans."""
    found = [m.span() for m in _TERM.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    free = []
    for a, b in found:
        k = bisect_right(ends, a)  # the first span that ends after the term's start
        free.append(k == len(merged) or merged[k][0] >= b)
    return found, free


def contexts(text: str, spans: list[tuple[str, int, int]], width: int = WIDTH) -> Iterator[tuple[str, int, int, str]]:
    """(entity, start, end, term) of the terms within width terms of a mention, outside all spans."""
    if not spans:
        return
    found, free = terms_outside(text, spans)
    starts, ends = [a for a, _ in found], [b for _, b in found]
    for kind, a, b in spans:
        e = entity(kind, text[a:b])
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        for k in (*range(max(0, before - width), before), *range(after, min(len(found), after + width))):
            if free[k]:
                yield e, starts[k], ends[k], text[starts[k] : ends[k]].lower()


def _scan(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """kind 0: term, n (its occurrences in a part of the corpus); kind 1: entity, term, context, n (its occurrences there).

    Batches have texts and the number of rows with the same text (null: one); each of these counts for its share.
    """
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        terms = pa.array(list(counts), pa.string())
        size = len(terms)
        arrays = [pa.array([0] * size, pa.int8()), pa.nulls(size, pa.string()), terms, pa.nulls(size, pa.int64()), pa.array(counts.values(), pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=_SEEN)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            entities, terms, marks, times = [], [], [], []
            for text, copies in zip(batch.column(0).slice(at, 1024).to_pylist(), batch.column(1).slice(at, 1024).to_pylist(), strict=True):
                if not text:
                    continue
                words = _TERM.findall(text.lower())
                if copies is None:
                    counts.update(words)
                else:
                    counts.update({t: n / copies for t, n in Counter(words).items()})
                if len(counts) > TERMS:
                    yield counted()
                    counts.clear()
                spans = base_spans(text)
                if spans:
                    found = list(contexts(text, spans, width))
                    by: dict[str, list[str]] = {}
                    places: dict[str, set[tuple[int, str]]] = {}  # contexts of one entity may overlap
                    for e, a, _, t in found:
                        by.setdefault(e, []).append(t)
                        places.setdefault(e, set()).add((a, t))
                    for e, ts in by.items():
                        mark = xxhash.xxh64_intdigest(" ".join(ts)) - (1 << 63)
                        for t, n in sorted(Counter(t for _, t in places[e]).items()):
                            entities.append(e)
                            terms.append(t)
                            marks.append(mark)
                            times.append(n / (copies or 1))
            if terms:
                kind = pa.array([1] * len(terms), pa.int8())
                yield pa.RecordBatch.from_arrays([kind, pa.array(entities), pa.array(terms), pa.array(marks, pa.int64()), pa.array(times, pa.float64())], names=_SEEN)
    if counts:
        yield counted()


def _with_copies(docs: DataFrame) -> DataFrame:
    """text, copies: the texts of docs with the number of rows that have the same one, null for texts of one row."""
    texts = docs.where("text is not null").select("text", key_of(F.col("text")).alias("key"))
    many = cut(texts.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"))
    return texts.join(F.broadcast(many) if many.count() <= COPIED else many, "key", "left").select("text", "copies")


def disclosing(
    docs: DataFrame, width: int = WIDTH, prior: float = PRIOR, disclosure: float = DISCLOSURE, remove: float = REMOVE
) -> DataFrame:
    """entity, term, p, ratio, removed, general: the terms of the corpus that disclose an entity, and what they are generalised to."""
    ship(docs.sparkSession)
    seen = cut(_with_copies(docs).mapInArrow(lambda it: releasing(_scan(it, width)), "kind byte, entity string, term string, mark long, n double"))
    # shares of copied texts add up to whole numbers but for rounding
    pairs = seen.where("kind = 1").groupBy("entity", "term", "mark").agg(F.sum("n").alias("n"))
    total = pairs.select("entity", "mark").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    joint = cut(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.sum("n").alias("inside")))
    counts = cut(seen.where("kind = 0").groupBy("term").agg(F.sum("n").alias("n_t")))  # a row for each different term
    n_t = counts.join(joint.select("term").distinct(), "term")
    whole = round(counts.agg(F.sum("n_t").alias("n")).collect()[0]["n"] or 1)
    p_e = F.least(F.lit(1.0), F.col("n_e") / F.lit(float(whole)))

    def estimate(n_te: Column, inside: Column, n_t: Column) -> tuple[Column, Column]:
        outside = F.greatest(F.round(n_t - inside), F.lit(0.0))
        p = (n_te + prior * p_e) / (n_te + outside + prior)
        return p, F.log2(p / p_e) / -F.log2(p_e)

    p, ratio = estimate(F.col("n_te"), F.col("inside"), F.col("n_t"))
    told = joint.join(n_t, "term").join(total, "entity").withColumns({"p": p, "ratio": ratio})
    told = cut(told.where(F.col("ratio") > disclosure).select("entity", "term", "n_e", "p", "ratio", (F.col("p") >= remove).alias("removed")))
    # the beginnings of a term, as long as its class may tell of the entity
    def begins(c: Column, short: int = 0) -> Column:
        to = F.least(F.length(c) - short, F.lit(LETTERS))
        return F.explode(F.transform(F.sequence(F.lit(1), to), lambda k: F.substring(c, F.lit(1), k))).alias("begin")

    wanted = told.where("not removed and length(term) > 1").select("entity", "term", "n_e", begins(F.col("term"), 1))
    asked = cut(wanted.select("begin").distinct())
    asked = F.broadcast(asked) if asked.count() <= BEGINS else asked
    of_class = counts.select(begins(F.col("term")), "n_t").join(asked, "begin").groupBy("begin").agg(F.sum("n_t").alias("n_t"))
    in_class = joint.join(wanted.select("entity").distinct(), "entity").select("entity", begins(F.col("term")), "n_te", "inside").join(asked, "begin")
    in_class = in_class.groupBy("entity", "begin").agg(F.sum("n_te").alias("n_te"), F.sum("inside").alias("inside"))
    p, ratio = estimate(F.col("n_te"), F.col("inside"), F.col("n_t"))
    general = wanted.join(of_class, "begin").join(in_class, ["entity", "begin"]).where(ratio <= disclosure)
    general = general.groupBy("entity", "term").agg(F.max_by("begin", F.length("begin")).alias("general"))
    out = told.join(general, ["entity", "term"], "left")
    return out.select("entity", "term", "p", "ratio", (F.col("removed") | F.col("general").isNull()).alias("removed"), F.when(~F.col("removed"), F.col("general")).alias("general"))


def _bits(found: DataFrame) -> np.ndarray:
    """The filter of found terms; at most FILTER numbers come to the driver."""
    bits = np.zeros(FILTER, bool)
    at = found.select(F.pmod(F.xxhash64("term"), F.lit(FILTER)).alias("at")).distinct().collect()
    bits[[r["at"] for r in at]] = True
    return np.packbits(bits)


def _marked(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """uid, terms (array of term, removed, general) of the texts that mention an entity beside terms that disclose it."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(found))  # of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(3)]
        filled = np.unpackbits(bits.value).view(bool)
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text)
            if spans:
                places, free = terms_outside(text, spans)
                terms = {text[a:b].lower() for (a, b), f in zip(places, free, strict=True) if f}
                terms = sorted(t for t in terms if filled[xxhash.xxh64_intdigest(t.encode(), 42) % FILTER])
                for e in sorted({entity(kind, text[a:b]) for kind, a, b in spans}):
                    cols[0] += [uid] * len(terms)
                    cols[1] += [e] * len(terms)
                    cols[2] += terms
        kinds = [pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "entity", "term"])

    mentions = map_slices(docs.select("uid", "text"), run, "uid long, entity string, term string").distinct()
    hits = mentions.join(found.select("entity", "term", "removed", "general"), ["entity", "term"])
    hits = hits.groupBy("uid", "term").agg(F.max("removed").alias("removed"), F.min_by("general", F.length("general")).alias("general"))
    return hits.groupBy("uid").agg(F.collect_list(F.struct("term", "removed", "general")).alias("terms"))


def places_of(text: str, base: list[tuple[str, int, int]], terms: list) -> list[tuple[int, int, bool, str | None]]:
    """start, end, removed, general of each place of a text's disclosing terms outside of its base spans."""
    if not terms:
        return []
    by = {t["term"]: (t["removed"], t["general"]) for t in terms}
    found, free = terms_outside(text, base)
    return [(a, b, *by[w]) for (a, b), f in zip(found, free, strict=True) if f and (w := text[a:b].lower()) in by]


def key_of(text: Column) -> Column:
    """A text's own number: rows of the same text have the same spans."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spans(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """uid (key_of the text), terms of each distinct text with disclosing terms (array of term, removed, general)."""
    found = cut(disclosing(docs, width, **limits))
    return cut(_marked(docs.select(key_of(F.col("text")).alias("uid"), "text"), found, width))


def _lightly(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= SMALL else terms


def _with_terms(docs: DataFrame, width: int, **limits) -> DataFrame:
    terms = spans(docs, width, **limits).select(F.col("uid").alias("__uid"), F.col("terms").alias("__terms"))
    return docs.join(_lightly(terms), key_of(F.col("text")) == F.col("__uid"), "left")


def report(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs; added spans have kinds term and general."""
    wide = _with_terms(docs.select(F.col("doc_id").cast("long"), "text"), width, **limits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: list[list[int]] = [[] for _ in KINDS]
        sha, every = [], []
        for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            base = base_spans(text)
            for k, kind in enumerate(KINDS):
                n[k].append(sum(s[0] == kind for s in base))
            sha.append(hashlib.sha256(written(base).encode()).hexdigest())
            more = places_of(text, base, terms)
            added = [("term", a, b) for a, b, removed, _ in more if removed] + [("general", a, b) for a, b, removed, _ in more if not removed]
            every.append(written(base + added))
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(every, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_slices(wide.select("doc_id", "text", "__terms"), run, schema)


def sanitise(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """docs with entities masked as [EMAIL] and so on, disclosing terms removed ([REDACTED]) or generalised to a beginning ([zan*])."""
    schema = docs.schema
    wide = _with_terms(docs, width, **limits).select(*docs.columns, "__terms")
    at = docs.columns.index("text")
    ship(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, terms in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            base = base_spans(text)
            found = [(a, b, f"[{k.upper()}]") for k, a, b in base]
            found += [(a, b, "[REDACTED]" if removed else f"[{general}*]") for a, b, removed, general in places_of(text, base, terms)]
            texts.append(mask(text, found) if found else text)
        arrays = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return map_slices(wide, run, schema)


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    out, end = [], 0
    for a, b, name in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= end:
            out += [text[end:a], name]
        end = max(end, b)
    return "".join(out) + text[end:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
