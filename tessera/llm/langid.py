"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: the text's likelihood under
character models, the language the markup declares, the address suffix, and a
prior of the host that is smoothed over its domain towards the whole crawl.
What a declaration, a suffix and a host are worth is learned by grouped
aggregation of the text posteriors over all pages."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.url_filter import url_host

#: Labelled texts that the character models are fitted on (a hash sample of about this many).
TRAIN_TEXTS = 5_000
#: Trigrams of the model: those seen this often, the most frequent first.
MIN_COUNT, MAX_GRAMS = 5, 50_000
#: Characters that count as independent evidence: trigrams overlap and repeat,
#: so a long text's log-likelihood is scaled down to this many.
EFFECTIVE = 60.0
#: Pseudo-pages of the level above.
SMOOTHING = 5.0

#: Beginnings of what is no running text: comments, elements, and blocks whose class says so.
_START = re.compile(r"<!--|<(script|style|head|nav|footer|aside|form|noscript|template)\b|<(div|section)\b", re.I)
_AD = re.compile(r"class=[\"']?(?:ad|ads|advert|menu|sidebar)\b", re.I)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in
        "script style head nav footer aside form noscript template div section".split()}
_TAG = re.compile(r"<[^>]*>?")
_LETTERS = re.compile(r"[^\W\d_]+")


def _without_furniture(page: str) -> str:
    """The page with a blank for every comment and furniture element, up to
    the next end tag of its name; a footer or nav without one goes to the end.
    One pass: an end tag that is missing is not looked for twice."""
    out, at, look, missing, last = [], 0, 0, set(), page.rfind(">")
    while m := _START.search(page, look):
        tag = (m.group(1) or m.group(2) or "").lower()
        look, end = m.end(), -1
        if not tag:
            end = -1 if "--" in missing else page.find("-->", look)
            missing |= {"--"} if end < 0 else set()
            end = end + 3 if end >= 0 else -1
        else:
            if m.group(2):
                close = page.find(">", look) if look <= last else -1
                if close < 0 or not _AD.search(page, look, close):
                    look = close + 1 if close >= 0 else look
                    continue
                look = close + 1
            found = None if tag in missing else _END[tag].search(page, look)
            if found:
                end = found.end()
            else:
                missing.add(tag)
                end = len(page) if tag in ("footer", "nav") else -1
        if end >= 0:
            out += [page[at:m.start()], " "]
            at = look = end
    return "".join([*out, page[at:]])


def visible_text(page: str | None) -> str:
    """The page's text without markup and the furniture that markup names."""
    return entities.unescape(_TAG.sub(" ", _without_furniture(page or "")))


def grams(text: str | None) -> Counter:
    """Character trigrams of the lower-cased words, blank-framed."""
    out: Counter = Counter()
    for w, k in Counter(_LETTERS.findall((text or "").lower())).items():
        w = f" {w} "
        for i in range(len(w) - 2):
            out[w[i:i + 3]] += k
    return out


class TextModel:
    """Smoothed trigram log-probabilities per language."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]]):
        self.langs = langs
        self.place = {g: i for i, g in enumerate(sorted(counts))}
        n = np.array([[counts[g].get(l, 0) + 0.5 for l in langs] for g in sorted(counts)] + [[0.5] * len(langs)])
        self.logs = np.log(n / n.sum(0))

    def posterior(self, text: str) -> list[float]:
        """P(language | text) under equal priors; without letters, uniform."""
        found = grams(text)
        if not found or not self.langs:
            return [1 / max(1, len(self.langs))] * len(self.langs)
        at = np.fromiter((self.place.get(g, -1) for g in found), np.int64, len(found))
        k = np.fromiter(found.values(), np.float64, len(found))
        score = k @ self.logs[at] * min(1.0, EFFECTIVE / k.sum())
        p = np.exp(score - score.max())
        return (p / p.sum()).tolist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def rows():
        flat = [(l, g, n) for l, c in counts.items() for g, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*flat)], names=["lang", "gram", "n"])
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(grams(text))
        if sum(map(len, counts.values())) > 200_000:
            yield rows()
            counts.clear()
    if any(counts.values()):
        yield rows()


def train_text_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     bound: int = TRAIN_TEXTS) -> TextModel:
    """Trigram counts over about ``bound`` labelled texts, chosen by a hash of the id."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003)
    some = known.filter(draw < (bound / n if n else 1.0)).select(text_col, lang_col)
    counted = some.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    often = (counted.groupBy("gram").agg(F.sum("n").alias("n"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by")).filter(F.col("n") >= MIN_COUNT)
        .orderBy(F.desc("n"), "gram").limit(MAX_GRAMS))
    counts = {r.gram: r.by for r in often.collect()}
    return TextModel(sorted({l for by in counts.values() for l in by}), counts)


def _text_posterior(model: TextModel, page: Column) -> Column:
    @F.arrow_udf("array<double>")
    def posterior(pages: pa.Array) -> pa.Array:
        return pa.array([model.posterior(visible_text(x)) for x in pages.to_pylist()], pa.list_(pa.float64()))
    return posterior(page)


def declared_language(page: Column) -> Column:
    """The primary subtag of the ``lang`` attribute of the html element, lower
    case; null if there is none."""
    tag = F.regexp_extract(page, r"(?i)<html\b([^>]*)>", 1)
    lang = F.regexp_extract(tag, r"""(?i)(?:^|\s)(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1)
    return F.when(lang != "", F.lower(lang))


def _sums(p: str, k: int) -> list[Column]:
    return [F.sum(F.col(p)[i]).alias(f"s{i}") for i in range(k)]


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """Per row: the id, ``lang``, ``confidence`` (its posterior), ``text_lang``
    (by the text alone), ``declared`` and ``suffix``.

    Priors, declarations and suffixes are those of the group's other pages.
    Very long and unclosed pages take time in proportion to their length.  No
    text: the other evidence decides; no declaration, host or suffix: that
    piece says what pages without it say.  Ties go to the first language in
    order.  Null urls and html are empty; repeated rows come back each; a model
    without languages gives null."""
    k = len(model.langs)
    if not k:
        return pages.select(id_col, *[F.lit(None).cast("string").alias(c) for c in ("lang", "text_lang", "declared", "suffix")],
                            F.lit(None).cast("double").alias("confidence"))
    host = url_host(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(declared_language(F.col(html_col)), F.lit("")).alias("declared"),
                        host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
                        F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"),
                        _text_posterior(model, F.col(html_col)).alias("p"))
    rows = materialise(rows, "langid")
    overall = rows.agg(*_sums("p", k)).first()
    total = sum(x or 0.0 for x in overall) or 1.0
    base = [((x or 0.0) + 1 / k) / (total + 1) for x in overall]

    whole = F.array(*[F.lit(b) for b in base])

    def others(sums: str, prior: Column) -> Column:
        """The mean posterior of a group's other pages, smoothed towards
        ``prior``: a page is no evidence for itself."""
        n = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x) - 1
        return F.transform(sums, lambda s, i: (F.greatest(s - F.col("p")[i], F.lit(0.0)) + SMOOTHING * prior[i])
                           / (F.greatest(n, F.lit(0.0)) + SMOOTHING))

    def grouped(*keys: str, name: str) -> DataFrame:
        t = rows.groupBy(*keys).agg(*_sums("p", k))
        return t.select(*keys, F.array(*[F.col(f"s{i}") for i in range(k)]).alias(name))
    hosts = grouped("host", "domain", name="of_host").join(grouped("domain", name="of_domain"), "domain").drop("domain")
    fused = (rows.join(hosts, "host").join(grouped("declared", name="of_markup"), "declared")
             .join(grouped("suffix", name="of_suffix"), "suffix"))
    fused = fused.withColumn("above", others("of_domain", whole)).withColumn("prior", others("of_host", F.col("above"))) \
        .withColumn("by_markup", others("of_markup", whole)).withColumn("by_suffix", others("of_suffix", whole))
    # what a declaration and a suffix speak for: P(language | value) / P(language)
    logs = F.array(*[F.log(F.greatest(F.col("p")[i], F.lit(1e-12))) + F.log(F.col("prior")[i]) + F.log(F.col("by_markup")[i] / base[i])
                     + F.log(F.col("by_suffix")[i] / base[i]) for i in range(k)])
    names = F.array(*[F.lit(l) for l in model.langs])
    top = F.array_max("logs")
    fused = fused.withColumn("logs", logs).withColumn("norm", F.aggregate(
        "logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("logs"))))
    best = F.element_at(names, F.array_position("logs", top).cast("int"))
    text_best = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    return fused.select(F.col("id").alias(id_col), best.alias("lang"), (1 / F.col("norm")).alias("confidence"),
                        text_best.alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"),
                        F.nullif("suffix", F.lit("")).alias("suffix"))
