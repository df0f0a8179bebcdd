"""Pages made for search engines: keyword stuffing, tag and product words, menus, link lists."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixloom.runtime import written

BLOCK = 2048
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.IGNORECASE)
_TAG = re.compile(r"<[^<>]{0,400}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\s,;:|>»<()\[\]{}!?\"“”*，；：！？。、]+")
# Lines that machines write: stack frames, patches, digests, logs, lists of versions.
_MACHINE = re.compile(
    r"\s*(?:#\d+\s+0x|at\s+[\w.$]+\(|diff --git|index [0-9a-f]+\.\.|--- |\+\+\+ |@@ |[-+] {2,}|[0-9a-fA-F]{32,}\b|\d{4}-\d\d-\d\d[T ]\d\d:|\[?\d\d:\d\d:\d\d|"
    r"[A-Za-z ]{0,20}:?\s*(?:v?\d+(?:\.\d+)+[,;\s]+)+v?\d+(?:\.\d+)+[,;\s]*$| {4,}\S.*[;{})]\s*$)"
)
# A sentence ends with one of the marks that scripts use for it (fixed values).
_CLOSE = re.compile(r"[^\W_](?:[.!?؟।።][\"')\]»”]*(?=\s|$)|\s[!?](?=\s|$)|[。！？｡])")


def _repeats(words: list[str]) -> float:
    """Share of the words in two-word phrases that come three times or more, mostly between ever new neighbours."""
    n = len(words)
    often = {p for p, c in Counter(zip(words, words[1:])).items() if c > 2}
    if not often:
        return 0.0
    at: dict[tuple[str, str], list[int]] = {p: [] for p in often}
    for i, p in enumerate(zip(words, words[1:])):
        if p in often:
            at[p].append(i)
    covered: set[int] = set()
    for places in at.values():
        before, after = {words[i - 1] if i else "" for i in places}, {words[i + 2] if i + 2 < n else "" for i in places}
        if min(len(before), len(after)) >= 0.6 * len(places):
            covered.update(places, (i + 1 for i in places))
    return len(covered) / n


def block_ratio(body: str) -> float:
    """Compressed bytes per character, averaged over equal blocks of about ``BLOCK`` characters that cover the whole text."""
    if not body:
        return 1.0
    k = max(1, round(len(body) / BLOCK))
    cuts = [len(body) * i // k for i in range(k + 1)]
    return float(np.mean([len(zlib.compress(body[a:b].encode("utf-8", "replace"), 1)) / (b - a) for a, b in zip(cuts, cuts[1:])]))


def measures(text: str) -> tuple[float, ...]:
    """What tells pages for machines from pages for people, in any language.

    0 characters, 1 words of any kind, counted up to 13, 2 share in link lines, 3 share of lines that machines write; of the rest: 4 words,
    5 block-wise compression ratio, 6 sentence ends per word, 7 share of phrases repeated between new neighbours.
    """
    plain = html.unescape(text)
    size, linked, technical, rest = 0, 0, 0, []
    for line in plain.splitlines():
        n = len(line.strip())
        size += n
        if not n:
            continue
        if _MACHINE.match(line):
            technical += n
            continue
        if "<" in line:
            line = _TAG.sub(lambda m: " " + " ".join(_URL.findall(m.group())) + " ", line)
        urls = _URL.findall(line) if "://" in line or "www." in line.lower() else ()
        if urls:
            line = _URL.sub(" ", line)
            if not _CLOSE.search(line):
                linked += n
                continue
            linked += sum(map(len, urls))
        rest.append(line)
    body = "\n".join(rest)
    words = [w for t in _TOKEN.findall(body.lower()) if "_" not in t and "/" not in t for w in _WORD.findall(t)]
    n = len(words)
    return size, len(plain.split(None, 12)), linked / max(size, 1), technical / max(size, 1), n, block_ratio(body), len(_CLOSE.findall(body)) / max(n, 1), _repeats(words) if n else 0.0


NAMES = ["doc_id", "size", "tokens", "linked", "machine", "words", "ratio", "closed", "phrases"]


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, *measures(t)) for i, t in zip(batch["doc_id"], batch["text"])]
        out = pd.DataFrame(rows, columns=NAMES)
        out["lang"] = batch["lang"].to_numpy()
        yield out


def page_measures(documents: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the measures of each text, in one pass."""
    lang = F.substring(F.lower(F.coalesce("lang", F.lit("und"))), 1, 2)
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("un").alias("lang"))
    return rows.mapInPandas(_measured, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES[1:]) + ", lang string")


def _usual(rows: DataFrame, *keys: str) -> DataFrame:
    real = F.col("words") >= 12
    return rows.groupBy(*keys).agg(F.percentile_approx(F.when(real, F.col("ratio")), 0.5).alias("ratio"), F.percentile_approx(F.when(real, F.col("closed")), 0.5).alias("closed"), F.sum(real.cast("long")).alias("n"))


def normalised(rows: DataFrame, enough: int = 50) -> DataFrame:
    """The measures with ``redundancy`` and ``sentences``: compression ratio and sentence density as multiples of the median.

    The median is that of all documents of the same language and length (powers of two); where those are fewer than
    ``enough``, of all documents of the length. One table of at most 27 x 26 languages x 64 lengths is broadcast.
    """
    rows = rows.withColumn("length", F.floor(F.log2(F.greatest("size", F.lit(1.0)))).cast("int"))
    rows = written(rows, "measures")
    own, every = _usual(rows, "lang", "length").toDF("lang", "length", "_r", "_c", "_n"), _usual(rows, "length").toDF("length", "_ra", "_ca", "_na")
    kept = F.col("_n") >= enough
    usual = own.join(F.broadcast(every), "length").select("lang", "length", F.when(kept, F.col("_r")).otherwise(F.col("_ra")).alias("_r"), F.when(kept, F.col("_c")).otherwise(F.col("_ca")).alias("_c"))
    joined = rows.join(F.broadcast(usual), ["lang", "length"])
    return joined.withColumns({"redundancy": F.col("ratio") / F.coalesce("_r", "ratio"), "sentences": F.col("closed") / F.greatest(F.coalesce("_c", F.lit(0.0)), F.lit(0.02))}).drop("_r", "_c", "length")


def spam_reason(links: float = 0.4, few: float = 0.5, silent: float = 0.93, strewn: tuple[float, float] = (0.18, 0.3), mixed: tuple[float, float] = (0.85, 0.95)) -> Column:
    """Why a page is none for people, or NULL. Each reason is a redundancy and a sentence density that confirms it.

    ``links``: most is lines that are a link with at most a caption, so that no sentence ends in them. Of the rest,
    ``redundant``: compresses better than usual (``silent``) and hardly a sentence ends (``few``). ``slogans``: compresses
    far better than usual, and sentences end far more often than in prose, as slogans do. ``keywords``: compresses
    better (``mixed``), and phrases repeated between ever new neighbours, which belong to no sentence around
    them, make up a good part (``strewn``); the larger that part, the less redundancy is asked.
    """
    redundancy, sentences = F.col("redundancy"), F.col("sentences")
    return (
        F.when(F.col("linked") >= links, "links")
        .when((F.col("machine") > 0.5) | (F.col("words") < 12), F.lit(None))
        .when((redundancy < silent) & (sentences < few), "redundant")
        .when(((redundancy < 0.6) & (sentences >= 1.25)) | ((redundancy < 0.75) & (sentences >= 1.9)), "slogans")
        .when(((redundancy < mixed[0]) & (F.col("phrases") >= strewn[0])) | ((redundancy < mixed[1]) & (F.col("phrases") >= strewn[1])), "keywords")
    )


def spam_pages(documents: DataFrame, least_words: int = 12) -> DataFrame:
    """``doc_id, reason`` of each page most of whose text is keywords, tags, product or menu words, or links.

    One pass measures every text whole: the block-wise compression ratio, sentence ends per word, the share of link
    lines and of repeated phrases. Ratio and sentence density are normalised by the medians of the corpus for language
    and length (``normalised``), and ``spam_reason`` decides. There is no list of words of any language.

    Lines that machines write (frames, patches, digests, logs, version lists) are set aside first, and a page that is
    mostly those is no case. NULL, empty and one-line texts (under ``least_words`` words of any kind) are no cases
    either. Copies and repeated rows each come out. Empty input gives no rows.
    """
    rows = normalised(page_measures(documents))
    return rows.where(F.col("tokens") >= least_words).select("doc_id", spam_reason().alias("reason")).where(F.col("reason").isNotNull())


def found(documents: DataFrame) -> DataFrame:
    return spam_pages(documents).select("doc_id")
