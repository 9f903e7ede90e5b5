"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a page multiply: the likelihood of its visible text
under character trigrams of each language; that of the language its markup
declares; that of its address suffix; and the prior of its host. The last three
are estimated on all pages by grouped sums of the text's posteriors. Host priors
are smoothed over a hierarchy, host to domain to all pages, and each page's own
share is taken out of its host's and domain's sums first.

The trigram model is fitted on about ``per_language`` documents of each language,
chosen by a hash of their ids; its counts are summed by Spark. Sums by host,
domain, suffix and declared language are tables that are joined: small ones are
broadcast by their size, large ones joined by shuffles that split hot keys.

Defined results: null html and text count as empty, and the other evidence then
decides; a missing or unknown declaration, suffix or host is a value of its own;
rows that repeat an id are judged each; an empty table gives an empty result;
without a labelled document there are no languages and all results are null.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Recent, small_batches, stage, text_of

PER_LANGUAGE = 500
#: Weight of the wider level in a smoothed prior, and of the uniform share in other counts.
PULL, SMOOTHING = 5.0, 1.0
#: Trigrams overlap, so they are not independent: their log likelihoods count a third.
TEMPER = 1 / 3
#: Words a task remembers.
CACHE = 50_000
#: A language's name and size take so much at most.
ROW_BYTES = 256
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""")


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


def visible(page: str) -> str:
    return markup.unescape(HIDDEN.sub(" ", page))


def place(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last three labels at most, without the first of more) and suffix."""
    try:
        host = (urlsplit((url or "").strip()).hostname or "").rstrip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    return host, ".".join(labels[1:] if len(labels) > 2 else labels), labels[-1] if len(labels) > 1 else ""


def trigram_counts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, gram, n) of about ``per_language`` documents of each language."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", text_of().alias("text"))
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("size")), "langid-sizes")
    if sizes.count() * ROW_BYTES <= BROADCAST_BYTES:  # else texts move to their language
        sizes = F.broadcast(sizes)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("size") < per_language * float(1 << 20)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"]):
                for word, n in Counter(WORD.findall(text.lower())).items():
                    for g in grams(word):
                        counts[lang, g] += n
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "gram", "n"])

    return rows.join(sizes, "lang").where(share).select("lang", "text").mapInPandas(of, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of trigrams, a column for each language."""

    def __init__(self, counts: pd.DataFrame):
        table = counts.pivot(index="gram", columns="lang", values="n").fillna(0.0) if len(counts) else pd.DataFrame()
        self.languages = list(table.columns)
        p = table.to_numpy(float) + 0.5
        self.unseen = np.log(0.5 / (p.sum(axis=0) + 0.5)) if len(table) else np.empty(0)
        self.rows = dict(zip(table.index, np.log(p / (p.sum(axis=0) + 0.5))))

    def word(self, word: str) -> np.ndarray:
        return np.sum([self.rows.get(g, self.unseen) for g in grams(word)], axis=0)


def evidence(pages: DataFrame, model: Model) -> DataFrame:
    """Slim rows: page_id, host, domain, suffix, declared, _text (log likelihoods) and _belief (text posteriors)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a bounded number of trigrams

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known = Recent(model.word, CACHE).__getitem__
        for pdf in batches:
            out = []
            for page_id, url, page in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                total = np.zeros(len(model.languages))
                for word, n in Counter(WORD.findall(visible(page).lower())).items():
                    total += n * known(word)
                text = TEMPER * (total - total.max()) if len(total) else total
                belief = np.exp(text)
                declared = m.group(1).lower() if (m := DECLARED.search(page)) else ""
                out.append((page_id, *place(url), declared, text, belief / belief.sum() if len(belief) else belief))
            yield pd.DataFrame(out, columns=["page_id", "host", "domain", "suffix", "declared", "_text", "_belief"])

    # Ids travel as text: beside a null, pandas would read large ones as floating point.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    out = rows.mapInPandas(of, "page_id string, host string, domain string, suffix string, declared string, _text array<double>, _belief array<double>")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def _sums(rows: DataFrame, by: list[str], size: int, name: str, belief: str = "_belief") -> DataFrame:
    """The sum of beliefs for each language, by key; written, so that Spark knows its size."""
    return stage(rows.groupBy(*by).agg(F.array(*(F.sum(F.col(belief)[k]) for k in range(size))).alias(name)), f"langid-{name.strip('_')}")


def _smoothed(counts: Column, own: Column, wider: Column) -> Column:
    """Counts without the page's own belief, pulled to the wider level's shares."""
    rest = F.zip_with(counts, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b) + PULL
    return F.zip_with(rest, wider, lambda a, w: (a + PULL * w) / total)


def identify(pages: DataFrame, docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """page_id, lang, probability, the evidence (declared, suffix, host) and what the text alone says."""
    small_batches(pages.sparkSession)
    model = Model(trigram_counts(docs, per_language).toPandas())  # a few thousand trigrams a language
    languages, size = model.languages, len(model.languages)
    if not size:
        null = F.lit(None)
        return pages.select("page_id", null.cast("string").alias("lang"), null.cast("double").alias("probability"), null.cast("string").alias("text_lang"), null.cast("string").alias("declared"), null.cast("string").alias("suffix"), null.cast("string").alias("host"))
    rows = stage(evidence(pages, model), "langid-evidence")
    total = rows.agg(*(F.coalesce(F.sum(F.col("_belief")[k]), F.lit(0.0)) for k in range(size))).first()
    every = [(x + SMOOTHING) / (sum(total) + size * SMOOTHING) for x in total]
    # Likelihood of a value given the language: its share of the language's sum.
    likelihood = {}
    for by in ("declared", "suffix"):
        sums = _sums(rows, [by], size, f"_{by}")
        values = sums.count()
        likelihood[by] = sums.withColumn(f"_{by}", F.array(*(F.log((F.col(f"_{by}")[k] + SMOOTHING) / (total[k] + SMOOTHING * (values + 1))) for k in range(size))))
    hosts = _sums(rows, ["host", "domain"], size, "_host")
    domains = _sums(hosts, ["domain"], size, "_domain", "_host")
    hosts = stage(hosts.join(domains, "domain").drop("domain"), "langid-hosts")
    wide = F.array(*map(F.lit, every))
    prior = _smoothed(F.col("_host"), F.col("_belief"), _smoothed(F.col("_domain"), F.col("_belief"), wide))
    joined = rows.join(hosts, "host").join(likelihood["declared"], "declared").join(likelihood["suffix"], "suffix").withColumn("_prior", prior)
    logs = F.array(*(F.col("_text")[k] + F.col("_declared")[k] + F.col("_suffix")[k] + F.log(F.col("_prior")[k]) for k in range(size)))
    names = F.array(*map(F.lit, languages))
    best = lambda x: names[F.array_position(x, F.array_max(x)).cast("int") - 1]
    return joined.withColumn("_log", logs).select(
        "page_id", best(F.col("_log")).alias("lang"),
        (1 / F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_log")))).alias("probability"),
        best(F.col("_text")).alias("text_lang"), "declared", "suffix", "host",
    )
