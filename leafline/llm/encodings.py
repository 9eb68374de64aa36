"""Problem 7: text decoded with the wrong encoding.

Noisy channel: a damaged stretch is some original text, written in one encoding and read in another. For each word with
a character beyond ASCII the bytes behind it are rebuilt for every known pair of encodings. If no byte is lost they are decoded again;
if some are (U+FFFD), they are a byte lattice whose paths are decoded by beam search under the character model (`lattice`), several candidates a
pair. Viterbi search over the words of a line finds the cheapest path through all readings and candidates: changes of pair are dear,
character triples of the whole corpus judge words without loss, and corpus frequencies of words and of pairs of words are added where bytes were lost.
The same search backwards gives the best path through every other candidate: `restored` is true only if the best text leads by SURE at every word.
A lost character on which the candidates within SURE disagree stays U+FFFD.

Corpus statistics: counts of triples by two hashes (SLOTS cells each, over all rows), and the words and pairs of words with a character beyond ASCII
that make up at least RATE of all (so at most 1 / RATE of each, at any size of the corpus), by 64-bit hashes.

Cases: null text is not damaged; empty text and pure ASCII are never touched; rows delivered twice count once; a damaged row
that cannot be restored comes out as far as it can be, with restored = false; empty tables give no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import lattice
from leafline.llm.lattice import LOST, to_bytes
from leafline.session import shared_table

SLOTS = 1 << 21
# Least share of a word (or pair of words) that is kept, and least count.
RATE, LEAST = 1e-6, 2
# Lead over every other text, in log likelihood, from which a row counts as restored; and weights of word and pair frequencies where bytes were lost.
# LOST_LEAD is added for each lost character, LOST_WORD for a word of which nothing else is left.
SURE, LOST_LEAD, LOST_WORD, WORD_WEIGHT, PAIR_WEIGHT = 3.0, 0.75, 6.0, 1.0, 1.0
# Bytes that happen to be valid UTF-8 are telling by themselves; any bytes are valid in the other encodings.
ENTER_UTF8, ENTER_OTHER, LEAVE, MARGIN, PLAUSIBLE = 1.0, 4.0, 0.5, 1.0, -1.6

# Encodings (read as, written in) that are confused in practice; in the first six pairs natural words are never valid. `sloppy` is cp1252 with C1 controls kept.
PAIRS = [
    *((w, "utf-8") for w in ("sloppy", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "gb18030", "big5", "shift_jis", "cp1250", "cp1254", "iso8859_15")),
    *((w, "cp1252") for w in ("cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "gb18030")),
    *((w, "cp1251") for w in ("sloppy", "koi8_r", "cp866", "mac_roman", "cp437")),
    *((w, "koi8_r") for w in ("cp1251", "sloppy", "cp866")),
    *((w, "cp866") for w in ("cp1251", "koi8_r", "sloppy", "cp437")),
    *((w, "gb18030") for w in ("sloppy", "big5", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "shift_jis")),
    *((w, "big5") for w in ("sloppy", "gb18030")),
    *(("sloppy", t) for t in ("cp437", "cp850", "mac_roman")),
    *(("utf-8", t) for t in ("cp1252", "cp1251", "koi8_r", "cp866")),
]


_UTF8 = sum(written == "utf-8" for _, written in PAIRS)  # these come first


def reread(text: str, read: str, written: str) -> str | None:
    """`text`, which was read as `read` without loss, decoded as `written`."""
    raw = to_bytes(text, read)
    return None if raw is None else _decoded(raw, written)


def _decoded(raw: bytes, written: str) -> str | None:
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        # The first or last character may have lost bytes at the border of a line.
        if written in ("utf-8", "gb18030") and len(raw) > 11 and sum(b > 127 for b in raw) > 11:
            out = raw.decode(written, "replace")
            return out if 1 <= out.count(LOST) <= 1 + len(out) // 12 else None
        return None


def _by_read(pairs: list[tuple[str, str]]) -> list[tuple[str, list[tuple[int, str]]]]:
    """The pairs (numbered from 1) by the encoding they were read in: its bytes are made once."""
    out: dict[str, list[tuple[int, str]]] = {}
    for k, (read, written) in enumerate(pairs, 1):
        out.setdefault(read, []).append((k, written))
    return list(out.items())


_READ = _by_read(PAIRS)


def triples(text: str) -> list[str]:
    """Triples of characters with one beyond ASCII, digits as one sign, spaces at the borders."""
    t = f"  {text} "
    return [x for x in map("".join, zip(t, t[1:], t[2:])) if not x.isascii()]


_DIGITS = re.compile(r"\d")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_ENDS = ".,;:!?()[]{}"
_STOPS = (".", "!", "?")


def _slots(part: str) -> tuple[int, int]:
    """Its cells in the two tables; the smaller count is nearly free of collisions."""
    h = xxhash.xxh64_intdigest(part)
    return h & (SLOTS - 1), (h >> 32) & (SLOTS - 1)


def _tokens(text: str) -> list[str]:
    return text.split(" ")


def _word(token: str) -> str:
    """What words are counted by: without marks at the ends, digits as one sign."""
    return _DIGITS.sub("0", token.strip(_ENDS) or token)


def _joint(before: str, after: str) -> str:
    """What pairs of words are counted by; the end of a sentence between them is kept."""
    return f"{_word(before)}{'.' if before[-1:] in _STOPS else ''} {_word(after)}"


def _hash(word: str) -> int:
    """The JVM's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


Reading = tuple[int, str, float]


class Corpus:
    """What the reader knows of the corpus."""

    def __init__(self, counts: np.ndarray, hashes: np.ndarray, often: np.ndarray, alphabet: str):
        self.hashes, self.often, self.alphabet = hashes, often, alphabet
        self._first, self._second = memoryview(np.ascontiguousarray(counts[0])), memoryview(np.ascontiguousarray(counts[1]))
        self.total = float(max(counts[0].sum(), 3)) / 3  # a triple is counted whole, without its last and as its last
        # A context rarer than this says little; it grows with the corpus, as repeated damage does.
        self.smooth = max(20.0, 1.5e-5 * self.total)
        self._known: dict[str, list[Reading]] = {}
        self._triples: dict[str, float] = {}
        self._steps: dict[str, float] = {}
        self._tries: dict[str, dict] = {}

    def frequency(self, word: str) -> float:
        """How often a word, or a pair of words with a space between, is in the corpus; 0 if it is rare."""
        h = _hash(word)
        i = int(self.hashes.searchsorted(h))
        return float(self.often[i]) if i < len(self.hashes) and self.hashes[i] == h else 0.0

    def likely(self, three: str) -> float:
        """Log likelihood of the third of three characters, as `worth` adds it up."""
        got = self._steps.get(three)
        if got is None:
            t = _DIGITS.sub("0", three)
            got = 0.0 if three.isascii() else self._triples.get(t) or self._triple(t)
            if len(self._steps) > 1_000_000:
                self._steps.clear()
            self._steps[three] = got
        return got

    def trie(self, written: str) -> dict:
        if written not in self._tries:
            self._tries[written] = lattice.trie([*map(chr, range(128)), *self.alphabet], written)
        return self._tries[written]

    def count(self, part: str) -> float:
        a, b = _slots(part)
        x, y = self._first[a], self._second[b]
        return x if x < y else y

    def _triple(self, t: str) -> float:
        alone = (self.count(t[2]) + 0.1) / self.total
        got = log((self.count(t) + self.smooth * alone) / (self.count(t[:2]) + self.smooth))
        if len(self._triples) > 1_000_000:
            self._triples.clear()
        self._triples[t] = got
        return got

    def worth(self, text: str) -> float:
        """Log likelihood of the triples beyond ASCII, each character given the two before it; a control or lost character costs more."""
        s, known = 0.0, self._triples
        for t in triples(_DIGITS.sub("0", text)):
            got = known.get(t)
            s += self._triple(t) if got is None else got
        return s - 4.0 * sum(c == LOST or "\x80" <= c < "\xa0" or "" <= c < "豈" for c in text)

    def readings(self, token: str) -> list[Reading]:
        """(pair, text, gain over the token as it is) of the possible readings, pair 0 being the token itself."""
        got = self._known.get(token)
        if got is None:
            got = self._lossy(token) if LOST in token else self._whole(token)
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[token] = got
        return got

    def _whole(self, token: str) -> list[Reading]:
        base = self.worth(token)
        out = [(0, token, 0.0)]
        # A word as plausible as any needs no reading, but repeated damage looks plausible too.
        if base >= PLAUSIBLE * len(triples(token)) and not _RUN.search(token):
            return out
        seen = {}
        for read, each in _READ:
            raw = to_bytes(token, read) if read != "utf-8" else None  # what was read as UTF-8 without loss is not damaged
            if raw is None:
                continue
            for k, written in each:
                text = _decoded(raw, written)
                if text is None or text == token:
                    continue
                if text not in seen:
                    seen[text] = self.worth(text) - base
                gain = seen[text]
                if read in ("sloppy", "latin-1") and written == "utf-8":
                    again = reread(text, read, written) if LOST not in text else None
                    if again is not None and again != text and (more := self.worth(again) - base) > gain:
                        text, gain = again, more
                # A reading must be plausible by itself: a rare character alone doesn't make a word damaged.
                if gain > -25 and base + gain > (-9.0 if k <= _UTF8 else -5.0) * max(1, len(triples(text))):
                    # A lone sign that is no letter is weak evidence in encodings where any byte is valid.
                    out.append((k, text, gain if k <= _UTF8 or len(token) > 1 or token.isalpha() else gain / 2))
        return out

    def _lossy(self, token: str) -> list[Reading]:
        """Candidates of the byte lattices of a token with lost characters."""
        base = self.worth(token)
        out = []
        for read, each in _READ:
            row = lattice.slots(token, read)
            for k, written in each if row is not None else ():
                for text, score in lattice.decode(token, row, read, written, self.trie(written), self.likely):
                    if score > (-9.0 if k <= _UTF8 else -7.0) * max(1, len(triples(text))):
                        out.append((k, text, score - base + WORD_WEIGHT * log(1 + self.frequency(_word(text)))))
        top = max((x[2] for x in out), default=0.0)
        return [(0, token, 0.0), *(x for x in out if x[2] > top - 15)]

    def _pair(self, before: str, after: str) -> float:
        return PAIR_WEIGHT * log(1 + self.frequency(_joint(before, after)))

    def restore(self, text: str) -> tuple[str, bool, bool]:
        """(text, damaged, restored) of one line."""
        if text.isascii():
            return text, False, False
        tokens = _tokens(text)
        spots = [i for i, t in enumerate(tokens) if not t.isascii()]
        if LOST not in text and all(len(self.readings(tokens[i])) == 1 for i in spots):
            return text, False, False
        nodes = [self._beside(tokens, i) for i in spots]

        def passed(j: int, k: int, a: Reading, b: Reading) -> float:
            """Cost of going from reading a of spot j to reading b of the next spot k."""
            cost = 0.0 if a[0] == b[0] else -(LEAVE if b[0] == 0 else ENTER_UTF8 if b[0] <= _UTF8 else ENTER_OTHER)
            if spots[k] == spots[j] + 1 and (LOST in tokens[spots[j]] or LOST in tokens[spots[k]]):
                cost += self._pair(a[1], b[1])
            return cost

        # Viterbi forwards and backwards: best[k][n] is the best path up to, or from, reading n of spot k.
        ahead = [[x[2] - (0.0 if x[0] == 0 else ENTER_UTF8 if x[0] <= _UTF8 else ENTER_OTHER) for x in nodes[0]]]
        for k in range(1, len(nodes)):
            ahead.append([max(s + passed(k - 1, k, a, b) for a, s in zip(nodes[k - 1], ahead[-1])) + b[2] for b in nodes[k]])
        after = [[0.0] * len(nodes[-1])]
        for k in range(len(nodes) - 1, 0, -1):
            after.append([max(passed(k - 1, k, a, b) + b[2] + s for b, s in zip(nodes[k], after[-1])) for a in nodes[k - 1]])
        after.reverse()
        changed, sure = False, True
        whole = max(ahead[-1])
        if whole > MARGIN:
            n = ahead[-1].index(whole)
            path = [n]
            for k in range(len(nodes) - 1, 0, -1):
                b = nodes[k][path[-1]]
                scores = [s + passed(k - 1, k, a, b) for a, s in zip(nodes[k - 1], ahead[k - 1])]
                path.append(scores.index(max(scores)))
            for k, n in enumerate(reversed(path)):
                pair, best, _ = nodes[k][n]
                # Other texts of this word by how far the best path through them falls behind; the more is lost, the more the lead must be.
                lost = tokens[spots[k]].count(LOST)
                lead = SURE + LOST_LEAD * lost + (LOST_WORD if lost > 1 and lost == len(tokens[spots[k]].strip(_ENDS)) else 0.0)
                close = {x[1] for x, a, b in zip(nodes[k], ahead[k], after[k]) if x[1] != best and a + b > whole - lead}
                sure = sure and not close
                if pair:
                    tokens[spots[k]], changed = self._supported(_common(best, close)) if lost else best, True
        out = " ".join(tokens)
        damaged = changed or LOST in text
        return out, damaged, changed and sure and LOST not in out

    def _supported(self, text: str) -> str:
        """`text` with U+FFFD for what no triple of the corpus speaks for, unless it is a known word."""
        if self.frequency(_word(text)):
            return text
        t = f"  {_DIGITS.sub('0', text)} "
        return "".join(c if c.isascii() or self.count(t[i + 2]) and all(self.count(t[j : j + 3]) for j in (i, i + 1)) else LOST for i, c in enumerate(text))

    def _beside(self, tokens: list[str], i: int) -> list[Reading]:
        """Readings of a token, with what its neighbours in ASCII say if it has lost characters."""
        found = self.readings(tokens[i])
        if LOST not in tokens[i] or len(found) == 1:
            return found
        before = tokens[i - 1] if i and tokens[i - 1].isascii() else None
        follows = tokens[i + 1] if i + 1 < len(tokens) and tokens[i + 1].isascii() else None
        return [(k, t, g + ((self._pair(before, t) if before else 0.0) + (self._pair(t, follows) if follows else 0.0) if k else 0.0)) for k, t, g in found]


def _common(best: str, others: set[str]) -> str:
    """`best` with the characters on which others of its length differ as lost ones."""
    same = [o for o in others if len(o) == len(best) and LOST not in o]
    return "".join(c if all(o[i] == c for o in same) else LOST for i, c in enumerate(best))


# No language has so many letters of the upper half of Latin-1 in a row.
_RUN = re.compile("[\x80-\xff]{4}")
_BROKEN = re.compile(f"[\x80-\x9f\ue000-\uf8ff{LOST}]")


def _looks_damaged(token: str) -> bool:
    """Damage that shows without statistics; such words stay out of them."""
    if _BROKEN.search(token):
        return True
    for read, _ in PAIRS[:6]:
        raw = to_bytes(token, read)
        # Two bytes beyond ASCII are the least that UTF-8 writes.
        if raw is not None and len(raw) > 1 and (t := _utf8(raw)) is not None and not t.isascii():
            return True
    return False


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


_KINDS = "kind byte, slot long, word string, n long"
_CELL, _WORD_KIND, _PAIR_KIND, _SIGN = range(4)
_UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿]")


def _statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    words: Counter[str] = Counter()
    signs: Counter[str] = Counter()
    tokens: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    joined: Counter[str] = Counter()

    def count() -> None:
        broken, named = set(), {}
        for token, n in tokens.items():
            if token.isascii():
                continue
            if LOST in token or _looks_damaged(token):
                broken.add(token)
                continue
            for t in triples(token):
                counts[t] += n
            for c in token:
                if c > "\x7f":
                    signs[c] += n
            if _UNSPACED.search(token):
                broken.add(token)  # runs without spaces are no words
            else:
                words[_word(token)] += n
        for (a, b), n in pairs.items():
            if a not in broken and b not in broken:
                for x in (a, b):
                    if x not in named:
                        named[x] = _word(x)
                joined[f"{named[a]}{'.' if a[-1:] in _STOPS else ''} {named[b]}"] += n
        tokens.clear()
        pairs.clear()

    def rows(kind: int, found: Counter) -> pd.DataFrame:
        n = len(found)
        none = kind == _CELL
        return pd.DataFrame(
            {"kind": np.full(n, kind, np.int8), "slot": pd.array(list(found) if none else [None] * n, "Int64"), "word": pd.array([None] * n if none else list(found), "string"), "n": pd.array(list(found.values()), "Int64")}
        )

    for frame in frames:
        for text in frame["text"]:
            line = _tokens(_DIGITS.sub("0", text))
            tokens.update(line)
            for ab in zip(line, line[1:]):
                if not (ab[0].isascii() and ab[1].isascii()):
                    pairs[ab] += 1
        if len(tokens) + len(pairs) > 300_000:
            count()
        for kind, found in ((_WORD_KIND, words), (_PAIR_KIND, joined)):
            if len(found) > 300_000:
                yield rows(kind, found)
                found.clear()
    count()
    slots: Counter[int] = Counter()
    for t, n in counts.items():
        for part in (t, t[:2], t[2]):
            a, b = _slots(part)
            slots[a] += n
            slots[SLOTS + b] += n
    for kind, found in ((_CELL, slots), (_WORD_KIND, words), (_PAIR_KIND, joined), (_SIGN, signs)):
        yield rows(kind, found)


def corpus_statistics(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """What `Corpus` is made of, over all rows; what reaches the driver is bounded by SLOTS, RATE and the number of characters there are."""
    beyond = chunks.select("text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    found = shared_table(beyond.mapInPandas(_statistics, _KINDS), "triples")
    cells = found.where(F.col("kind") == _CELL).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SLOTS, np.int64)
    counts[cells["slot"].to_numpy()] = cells["n"].to_numpy()
    named = found.where(F.col("kind").isin(_WORD_KIND, _PAIR_KIND)).groupBy("kind", "word").agg(F.sum("n").alias("n"))
    every = {r["kind"]: r["n"] for r in found.where(F.col("kind").isin(_WORD_KIND, _PAIR_KIND)).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = {kind: max(LEAST, RATE * every.get(kind, 0)) for kind in (_WORD_KIND, _PAIR_KIND)}
    kept = named.where(F.col("n") >= F.when(F.col("kind") == _WORD_KIND, least[_WORD_KIND]).otherwise(least[_PAIR_KIND])).select(F.xxhash64("word").alias("h"), "n").toArrow()
    hashes, often = kept["h"].to_numpy(), kept["n"].to_numpy()
    order = np.argsort(hashes)
    signs = found.where(F.col("kind") == _SIGN).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy("word").collect()
    counts = counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64)
    return counts.reshape(2, SLOTS), hashes[order], often[order], "".join(r["word"] for r in signs)


def restored_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, restored): the damaged rows, with their text as far as it can be restored."""
    shared = chunks.sparkSession.sparkContext.broadcast(corpus_statistics(chunks))

    def restore(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = Corpus(*shared.value)
        for frame in frames:
            rows = []
            for i, text in zip(frame["id"], frame["text"]):
                out, damaged, whole = corpus.restore(text)
                if damaged:
                    rows.append((i, out, whole))
            yield pd.DataFrame(rows, columns=["chunk_id", "text", "restored"]).astype({"chunk_id": "int64", "text": "string", "restored": "bool"})

    beyond = chunks.select("id", "text").where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    return beyond.mapInPandas(restore, "chunk_id long, text string, restored boolean").dropDuplicates(["chunk_id"])


def damaged_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id): rows of which some part was decoded with another encoding than it was written in."""
    return restored_rows(chunks).select("chunk_id")
