"""Problem 10: subject areas of each document, from a latent Dirichlet topic model.

The model is fitted by distributed expectation maximisation (one Spark job a round, expected counts summed over partitions) on
at most SAMPLE labelled documents, a documented bound. Its topics are one for each subject, which documents with that
label prefer, and BACKGROUND topics open to all; a wrong label costs a document only its preference. A topic stands for the subject with whose labels
its top terms go together.

Topic proportions are then inferred for every document, in units of sentences, as the result is asked in them: a sentence draws one subject (or none)
from the document's proportions theta, and each of its terms comes from the subject's topic with probability MIXED, else from the background.
Expectation maximisation over the sentences gives theta; the proportion of a subject is the share of sentences that are most
likely its own under theta, so a garbled sentence without a known term goes with its document. Subjects of at least SHARE are assigned.

Sentences are those of documents.text without lines that its source repeats (problem 6) and without title lines and bare page numbers. A stop after an
abbreviation ends none: abbreviations are learnt from the sample, as words (or numbers after a word) that hardly ever stand without a stop.

Cases: null, empty or blank text has no row; labels are trimmed and lower-cased, unknown and null labels are left out, a document
may have several; rows delivered twice count once; without any usable label there is no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import boilerplate
from leafline.session import cut_lineage

SAMPLE, BACKGROUND, ROUNDS, VOCABULARY = 4000, 3, 5, 60_000
SHARE, TOP_TERMS = 0.25, 40
# Share of a sentence's terms that come from its subject, prior sentences of each subject and of none, rounds of inference.
MIXED, PRIOR, INFERENCE = 0.05, 0.3, 12
# An abbreviation has a stop in at least this share of its places, and at least so many places; parts of the fit are at most FITS.
STOPPED, PLACES, FITS = 0.95, 5, 16
OWN, OTHER, COMMON, SMOOTH = 1.0, 0.02, 1.0, 0.02

_TERM = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]{2,}")
_BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-=–¬‐‑­]\n(?=[^\W\d_])")
_SENTENCE = re.compile(r"""(?<=[.!?…])["'”’»)\]]*(?:\s*[\[({][^\])}\n]*[\])}]\s*\.?)?\s+(?=[^\sa-zа-я])|(?<=[。！？])[”’」]?""")
_PLACE = re.compile(r"(?<![^\s(\[{])(?:([^\W\d_]+)\s+)?(\d+|[^\W\d_]{1,5})(\.?)(?=[\s,;:)\]])")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def terms(text: str) -> list[str]:
    """Words in lower case; Chinese runs as pairs of signs."""
    out = []
    for w in _TERM.findall(text.lower()):
        if w[0] >= "㐀" and "㐀" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def _key_hash(letters: str) -> int:
    """The hash that the JVM's xxhash64 gives a line's key."""
    import xxhash

    if not letters.isalpha():
        letters = "".join(filter(str.isalpha, letters))
    h = xxhash.xxh64_intdigest(letters, 42)
    return h - (1 << 64) if h >> 63 else h


def _stop_key(before: str | None, word: str) -> str:
    """What a stop is judged by: a number by the word before it, other words by themselves."""
    return f"{(before or '').lower()} 0" if word.isdigit() else word


def _stopped_short(before: str, short: frozenset[str]) -> bool:
    """Whether what stands before a stop ends in an abbreviation."""
    words = before.rsplit(None, 2)[-2:]
    last = words[-1].lstrip("([{") if words else ""
    return _stop_key(words[0] if len(words) > 1 else None, last) in short


def stops(text: str) -> Counter[tuple[str, bool]]:
    """How often short words and numbers stand with and without a stop."""
    return Counter((_stop_key(m[1], m[2]), bool(m[3])) for m in _PLACE.finditer(text))


def sentences(text: str, frequent: set[int], title: str | None, short: frozenset[str] = frozenset()) -> list[str]:
    """Sentences of a document without the lines whose keys' hashes are `frequent` and without title lines and page numbers; a stop after `short` ends none."""
    named = _NOT_LETTER.sub("", (title or "").lower())
    kept = []
    for line in text.split("\n"):
        letters = _NOT_LETTER.sub("", line.lower())
        if not letters or frequent and len(letters) >= boilerplate.LETTERS and _key_hash(letters) in frequent or len(letters) > 5 and named and (named.startswith(letters) or letters.startswith(named)) and len(letters) > 0.6 * len(named):
            continue
        kept.append(line)
    whole = _BROKEN_WORD.sub("", "\n".join(kept)).replace("\n", " ")
    out, begin = [], 0
    for m in _SENTENCE.finditer(whole):
        if short and whole[m.start() - 1] == "." and _stopped_short(whole[max(begin, m.start() - 60) : m.start() - 1], short):
            continue
        out.append(whole[begin : m.start()])
        begin = m.end()
    out.append(whole[begin:])
    return [s for s in out if len(_NOT_LETTER.sub("", s)) >= 4]


def _labelled(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, text, labels) of at most about SAMPLE labelled documents, drawn by the hash of their id."""
    known = subjects.select(F.lower(F.trim("subject")).alias("label")).distinct()
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("label")).join(known, "label").groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    have = cut_lineage(clean.where("doc_id is not null"))
    share = min(1.0, SAMPLE / max(1, have.count()))
    drawn = have.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return documents.select("doc_id", "text").where("text is not null").join(drawn, "doc_id")


def fit_topics(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[dict[str, int], np.ndarray, list[str], frozenset[str]]:
    """(term numbers, topics x terms probability of a term in each topic, subject of each topic or '', abbreviations)."""
    names = sorted({r[0] for r in subjects.select(F.lower(F.trim("subject"))).where("subject is not null").collect()})
    sample = _labelled(documents, labels, subjects).repartition(FITS)  # bounded, so its rows are few a part and the parts are few

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, mine in zip(frame["text"], frame["labels"]):
                c, places = Counter(terms(_BROKEN_WORD.sub("", text))), stops(text)
                rows.append((list(c), list(c.values()), list(mine), [f"{int(on)}{w}" for w, on in places], list(places.values())))
            yield pd.DataFrame(rows, columns=["terms", "counts", "labels", "places", "often"])

    bags = cut_lineage(sample.mapInPandas(counted, "terms array<string>, counts array<int>, labels array<string>, places array<string>, often array<int>"))
    place = bags.select(F.explode(F.arrays_zip("places", "often")).alias("x")).select(F.substring("x.places", 2, 100).alias("w"), F.when(F.col("x.places").startswith("1"), F.col("x.often")).otherwise(0).alias("on"), "x.often")
    mostly = place.groupBy("w").agg(F.sum("on").alias("on"), F.sum("often").alias("n")).where((F.col("n") >= PLACES) & (F.col("on") >= STOPPED * F.col("n")))
    short = frozenset(r["w"] for r in mostly.select("w").collect())
    found = bags.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "t").limit(VOCABULARY).collect()
    number = {r["t"]: i for i, r in enumerate(found)}
    if not number:
        return {}, np.zeros((len(names), 0)), names, short
    k, v = len(names) + BACKGROUND, len(number)
    place = {s: i for i, s in enumerate(names)}
    # How terms go together with labels: it starts the topics and, at the end, tells what their top terms mean.
    seen = bags.select(F.explode("labels").alias("label"), "terms").select("label", F.explode("terms").alias("t")).groupBy("label", "t").agg(F.count("*").alias("n"))
    together = np.zeros((len(names), v))
    for r in seen.join(seen.sparkSession.createDataFrame([(t,) for t in number], "t string"), "t").collect():
        together[place[r["label"]], number[r["t"]]] = r["n"]
    lift = (together + 0.5) / (together.sum(1, keepdims=True) + 1)
    lift /= lift.sum(0)
    lone = np.clip((lift.max(0) - 1.0 / len(names)) / max(1e-9, 1 - 1.0 / len(names)), 0, 1) ** 2
    made = np.random.default_rng(11)
    phi = np.concatenate([together * lift**2 * lone + 1e-3, (together.sum(0) * (1 - lone) + 1e-3) * made.gamma(20.0, 0.05, (BACKGROUND, v))])
    phi /= phi.sum(1, keepdims=True)
    context = documents.sparkSession.sparkContext
    vocabulary = context.broadcast(number)
    for _ in range(ROUNDS):
        shared = context.broadcast(phi)

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, index = shared.value, vocabulary.value
            total = np.zeros((k, v))
            for frame in frames:
                for words, counts, mine in zip(frame["terms"], frame["counts"], frame["labels"]):
                    at = [(index[w], n) for w, n in zip(words, counts) if w in index]
                    if not at:
                        continue
                    ids, n = np.array(at).T
                    prior = np.full(k, OTHER)
                    prior[len(names) :] = COMMON
                    prior[[place[s] for s in mine if s in place]] = OWN
                    theta, words_p = prior / prior.sum(), p[:, ids]
                    for _ in range(6):
                        share = theta[:, None] * words_p
                        share /= share.sum(0) + 1e-300
                        theta = (share * n).sum(1) * np.minimum(1, prior / OWN + 0.02) + prior * 0.5
                        theta /= theta.sum()
                    np.add.at(total, (slice(None), ids), share * n)
            yield pd.DataFrame({"topic": np.arange(k), "row": list(total)})

        sums = np.zeros((k, v))
        each = bags.mapInPandas(expect, "topic int, row array<double>").groupBy("topic").agg(F.collect_list("row").alias("rows"))
        adds = F.aggregate("rows", F.array_repeat(F.lit(0.0), v), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        for r in each.select("topic", adds.alias("row")).collect():
            sums[r["topic"]] = r["row"]
        phi = (sums + SMOOTH) / (sums + SMOOTH).sum(1, keepdims=True)
    background = phi[len(names) :].mean(0)
    meaning = []
    for j in range(k):
        top = np.argsort(-phi[j] * np.log((phi[j] + 1e-12) / (background + 1e-6)))[:TOP_TERMS]
        score = (lift[:, top] * phi[j, top]).sum(1) / phi[j, top].sum()
        meaning.append(names[int(score.argmax())] if j < len(names) and score.max() > 0.25 + 0.75 / len(names) else "")
    return number, phi, meaning, short


def sentence_scores(phi: np.ndarray, meaning: list[str], names: list[str]) -> np.ndarray:
    """terms x (subjects and none): what each term adds to a sentence's log likelihood over one from the background alone."""
    background = phi[[j for j, m in enumerate(meaning) if not m]]
    base = (background.mean(0) if len(background) else phi.mean(0)) + 1.0 / max(1, 50 * phi.shape[1])
    out = np.zeros((phi.shape[1], len(names) + 1), np.float32)
    for j, m in enumerate(meaning):
        if m:
            out[:, names.index(m)] = np.log(1 - MIXED + MIXED * phi[j] / base)
    return out


def proportions(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """documents x (subjects and none): shares of each document's sentences (rows of `scores`, `sizes` of them a document, none without) that are
    most likely each subject's under the document's inferred proportions. All documents are worked at once."""
    k = scores.shape[1]
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Documents start as half about nothing, and stay so if no term speaks for a subject.
    theta = np.full((len(sizes), k), 0.5 / max(1, k - 1))
    theta[:, -1] = 0.5
    likely = np.exp(scores - scores.max(1, keepdims=True))
    for _ in range(INFERENCE):
        share = likely * theta[owner]
        share /= share.sum(1, keepdims=True)
        theta = (np.add.reduceat(share, begin, axis=0) + PRIOR) / (sizes + PRIOR * k)[:, None]
    top = (likely * theta[owner]).argmax(1)
    return np.bincount(owner * k + top, minlength=len(sizes) * k).reshape(-1, k) / sizes[:, None]


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects of at least a quarter of the sentences of each text."""
    number, phi, meaning, short = fit_topics(documents, labels, subjects)
    names = sorted({m for m in meaning if m})
    codes = {r[0].strip().lower(): r[0] for r in subjects.select("subject").where("subject is not null").collect()}
    shared = documents.sparkSession.sparkContext.broadcast((number, sentence_scores(phi, meaning, names), short))
    usable = documents.where("text is not null and doc_id is not null")
    lines = usable.select(F.col("id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).withColumn("id", F.lit(0))
    often = boilerplate.frequent_lines(lines, documents).select("source", "key_hash")
    # A source's frequent lines are at most lines of a document / LEAST_SHARE; they travel with its documents.
    hashes = often.groupBy("source").agg(F.collect_set("key_hash").alias("often"))
    work = usable.join(hashes, "source", "left").select("doc_id", "title", "text", "often")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, worth, stopped = shared.value
        for frame in frames:
            docs, sizes, found, held = [], [], [], []
            for doc, title, text, often in zip(frame["doc_id"], frame["title"], frame["text"], frame["often"]):
                every = sentences(text, set(often.tolist()) if often is not None else set(), title, stopped)
                if every and names and index:
                    docs.append(doc)
                    sizes.append(len(every))
                    for sentence in every:
                        ids = [i for i in map(index.get, terms(sentence)) if i is not None]
                        found += ids
                        held.append(len(ids))
            out = []
            if docs:
                scores = np.zeros((len(held), len(names) + 1))
                held = np.array(held)
                full = np.flatnonzero(held)
                if len(full):
                    scores[full] = np.add.reduceat(worth[np.array(found)], (np.cumsum(held) - held)[full], axis=0)
                at, subject = np.nonzero(proportions(scores, np.array(sizes))[:, :-1] >= SHARE)
                out = [(docs[i], codes[names[j]]) for i, j in zip(at.tolist(), subject.tolist())]
            yield pd.DataFrame(out, columns=["doc_id", "subject"])

    return work.mapInPandas(assign, "doc_id long, subject string").distinct()


def corpus_composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, documents): how many documents are about each subject."""
    return document_subjects(documents, labels, subjects).groupBy("subject").agg(F.count("*").alias("documents"))
