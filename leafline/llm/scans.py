"""Problem 5: text from scanned pages repaired into continuous paragraphs.

Rows with source `ocr` are gathered by page, a group bounded by what a page holds, together with the first LOOK
rows of the next page and the page before; so a word that goes on overleaf is seen without gathering a document. On a page
* margin rows are peeled off from the head and foot: the page's number in any dress, the document's title or a cut or damaged form of it, or both;
  a row that recurs at the edge of other pages of the document, but for confusable letters and numbers; and a name that no running text would break off at;
* a row whose last word goes on in the next row of running text is a hyphen row, also if the sign is a look-alike or missing;
* misread characters are found by a noisy channel: words that are rare in the corpus get the candidates from which known character
  confusions could have made them, and Viterbi search over the line weighs confusion probabilities against word pair likelihoods.

The probability of each confusion is estimated from the scanned rows themselves, by one round of expectation maximisation over their words: how often
it explains a rare word by a likelier one, against how often what is printed occurs. CONFUSED is where the round starts and what few occurrences are smoothed to.

Corpus counts (words, word pairs, characters of words) are hashed into tables of fixed size over all rows; rows that were not
scanned count CLEAN times as much, so that repeated misreadings don't become words. From every count is taken what a cell of its table holds by chance, the
table's upper quartile: nothing while the tables are mostly empty, and in full ones what a word that never occurred would seem to have.

Cases: null text is no row; pages without number are runs of 64 ordinals; rows delivered twice count once; ties in line are ordered by
ordinal and id; a document without a row in the documents table has no title; empty tables give no row.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.session import shared_table

SLOTS, CLEAN, LOOK, PART = 1 << 22, 20, 3, 64
# Longest row that counts as a recurring margin row.
EDGE = 120
# Tables: words and word pairs, each by two hashes, and triples of characters.
TABLES = 5
# Log probabilities of one confusion, of a word outside the counts, and the weight of single words beside pairs.
CONFUSED, UNSEEN, SINGLE = log(2e-3), log(1e-3), 20.0
# Occurrences that the start of the confusions counts for, and the most probable a confusion can get.
WEIGHT, MOST = 1000, 0.2
# The same of a confusion of Chinese look-alikes, and unscanned occurrences under which a Chinese character is rare.
HAN_CONFUSED, RARE = log(1e-2), 5

# What scanners confuse (printed, read).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("o", "0"), ("n", "u"), ("u", "n"), ("l", "1"), ("i", "1"), ("s", "5"), ("d", "cl"), ("h", "b"), ("b", "h"),
    ("g", "9"), ("m", "rn"), ("rn", "m"), ("b", "6"), ("w", "vv"), ("li", "h"), ("ll", "h"), ("z", "2"), ("a", "o"), ("g", "q"), ("nn", "m"), ("ri", "n"), ("в", "8"), ("з", "3"),
    ("е", "с"), ("с", "е"), ("и", "п"), ("п", "и"), ("н", "п"), ("п", "н"), ("о", "0"), ("и", "н"), ("н", "и"), ("л", "п"), ("ш", "щ"), ("ц", "ч"),
    ("é", "e"), ("é", "6"), ("ö", "o"), ("ü", "u"), ("ä", "a"), ("å", "a"), ("ß", "b"), ("ß", "B"), ("0", "o"), ("1", "l"),
]
_BACK: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _BACK.setdefault(_b, []).append(_a)

# The same of Chinese characters; and those of equal look in both directions.
HAN_CONFUSIONS = [tuple(p) for p in "的旳 有肬 是昰 在茬 人入 分兵 更便 记讱 和禾".split()]
for _a, _b in "人入 已己 已巳 己巳 未末 土士 日曰 大太 大犬 太犬 天夫 天无 千干 干于 木本 木术 王玉 白自 间问 今令 力刀 九丸 贝见 历厉 没设 话活 清请 清情 请情 纪记 休体 末朱 田由 由甲 甲申 目自 史吏 兔免 乌鸟 拔拨 侯候 晴睛 右石 住往 待侍 折拆 析折".split():
    HAN_CONFUSIONS += [(_a, _b), (_b, _a)]
_HAN_BACK: dict[str, list[str]] = {}
for _a, _b in dict.fromkeys(HAN_CONFUSIONS):
    _HAN_BACK.setdefault(_b, []).append(_a)

_TOKEN = re.compile(r"[㐀-鿿]+|[^\W_㐀-鿿]+")
_HAN = re.compile(r"[㐀-鿿]")
_TAIL = re.compile(r"([^\W\d_㐀-鿿]+(?:['’\-][^\W\d_㐀-鿿]+)*)([-=–—¬‐‑­]?)\s*$")
_HEAD = re.compile(r"^\s*([^\W\d_㐀-鿿]+)")
_NAME = re.compile(r"""[^\s.,;:!?…()\[\]{}«»“”„"]+$""")
_HAN_NAME = re.compile(r"[㐀-鿿]{2,4}$")
_END = re.compile(r"""[.!?…。！？:]["'”’»)\]]*\s*$""")
_NUMBERED = re.compile(r"(?i)\b(?:page|seite|p|s|pag|стр|страница|folio|f)\b\.?|[第页頁]")
_DIGITS = str.maketrans("lIiOoSsBbgqZz", "1110055869922"[:13])
# Signs of a wrong encoding, which is not the scanner's fault.
_BROKEN = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_ROMAN = [(100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def _roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        while n >= value and n < 4000:
            out += sign
            n -= value
    return out


def _cells(kind: int, part: str) -> tuple[int, ...]:
    """Cells of a word (kind 0), a pair (1) or a piece of a word (2)."""
    h = xxhash.xxh64_intdigest(part)
    if kind == 2:
        return (4 * SLOTS + (h & (SLOTS - 1)),)
    return 2 * kind * SLOTS + (h & (SLOTS - 1)), (2 * kind + 1) * SLOTS + ((h >> 32) & (SLOTS - 1))


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)] or [w]


class Language:
    """Likelihoods from the hashed counts; the smaller of two cells is nearly free of collisions."""

    def __init__(self, counts: np.ndarray, noise: list[int] | None = None, rates: dict[tuple[str, str], float] | None = None):
        self.noise, self.rates = noise or chance(counts), rates or {}
        self.tables = [memoryview(np.ascontiguousarray(t)) for t in counts.reshape(TABLES, SLOTS)]
        self.words = float(max(counts[:SLOTS].sum(dtype=np.int64), 1))
        self.signs_total = self.count(2, "=") + 1
        self._word: dict[str, tuple[float, float]] = {}
        self._gram: dict[str, float] = {}
        self._fixes: dict[str, list[tuple[str, float]]] = {}
        self.used: dict[str, dict[str, tuple]] = {}

    def count(self, kind: int, part: str) -> float:
        h = xxhash.xxh64_intdigest(part)
        at = 2 * kind
        least = self.tables[at][h & (SLOTS - 1)] - self.noise[at]
        if kind != 2:
            other = self.tables[at + 1][(h >> 32) & (SLOTS - 1)] - self.noise[at + 1]
            if other < least:
                least = other
        return float(least) if least > 0 else 0.0

    def spelt(self, word: str) -> float:
        s = 0.0
        for g in _grams(word):
            got = self._gram.get(g)
            if got is None:
                got = self._gram[g] = log((self.count(2, g) + 0.05 * CLEAN) / (self.count(2, "~" + g[:2]) + 2.0 * CLEAN))
                if len(self._gram) > 500_000:
                    self._gram.clear()
            s += got
        return s

    def word(self, word: str) -> tuple[float, float]:
        """(count, log likelihood) of a word in lower case, without one scanned occurrence: its own."""
        got = self._word.get(word)
        if got is None:
            n = max(0.0, self.count(0, word) - 1)
            p = n / self.words
            likely = log(p + 1e-300) if p > 0 else -700.0
            if p < 1e-5:
                spelt = UNSEEN + self.spelt(word)
                likely = max(likely, spelt) + log(1 + np.exp(-abs(likely - spelt)))
            if len(self._word) > 500_000:
                self._word.clear()
            got = self._word[word] = (n, likely)
        return got

    def fixes(self, word: str) -> list[tuple[str, float]]:
        """Candidates (word in lower case, log probability of the confusion), the word itself first."""
        got = self._fixes.get(word)
        if got is not None:
            return got
        out = {word: 0.0}
        used: dict[str, tuple] = {word: ()}
        # Only words that are not frequent have candidates; those must be far likelier than the word.
        if self.word(word)[0] < max(3 * CLEAN, 2e-5 * self.words) and len(word) > 2 and not word.isdigit():
            base = self.word(word)[1]
            front = [word]
            for _ in (1, 2):
                new = {}
                for w in front:
                    for i in range(len(w)):
                        for k in (1, 2):
                            read = w[i : i + k]
                            for a in _BACK.get(read, ()) if i + k <= len(w) else ():
                                c = w[:i] + a + w[i + k :]
                                channel = out[w] + self.rates.get((a, read), CONFUSED)
                                if c not in out and (gain := self.word(c)[1] + channel - base) > -3 and gain > new.get(c, (-1e9,))[0]:
                                    new[c] = gain, channel, (*used[w], (a, read))
                front = sorted(new, key=lambda c: -new[c][0])[:3]
                for c in front:
                    _, out[c], used[c] = new[c]
            if len(out) > 1:
                self.used[word] = used
        if len(self._fixes) > 300_000:
            self._fixes.clear()
            self.used.clear()
        got = self._fixes[word] = list(out.items())
        return got

    def line(self, words: list[str]) -> list[str]:
        """The likeliest printed words (in lower case) of a line of read ones: Viterbi over candidates and pairs."""
        if all(len(self.fixes(w)) == 1 for w in words):
            return words
        best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
        for w in words:
            new = {}
            for c, channel in self.fixes(w):
                single = self.word(c)[1]
                top = None
                for before, (s, path) in best.items():
                    pair = (self.count(1, before + " " + c) + SINGLE * np.exp(single)) / (self.count(0, before) + SINGLE) if before else np.exp(single)
                    # Half pairs, half words: names are in few pairs.
                    value = s + channel + 0.75 * single + 0.25 * log(pair + 1e-300)
                    if top is None or value > top[0]:
                        top = (value, path)
                new[c] = (top[0], (top[1], c))  # type: ignore[index]
            best = new
        _, path = max(best.values(), key=lambda x: x[0])
        out: list[str] = []
        while path:
            path, c = path
            out.append(c)
        return out[::-1]

    def _sign(self, sign: str) -> float:
        return max(0.0, self.count(2, "=" + sign) - 1)

    def _beside(self, pair: str) -> float:
        return max(0.0, self.count(2, "=" + pair) - 1)

    def signs(self, run: str) -> str:
        """The likeliest printed Chinese characters of a run of read ones: Viterbi over look-alikes and pairs, as for words."""
        if not any(c in _HAN_BACK for c in run):
            return run
        signs = self.signs_total

        def single(sign: str) -> float:
            return (self._sign(sign) + 0.1) / (signs + 1000)

        best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
        for read in run:
            new = {}
            for c in (read, *_HAN_BACK.get(read, ())):
                p = single(c)
                channel = 0.0 if c == read else HAN_CONFUSED
                top = None
                for before, (s, path) in best.items():
                    # Weights that don't depend on counts, or an unseen neighbour would speak for the rarer sign.
                    likely = log(0.7 * min(1.0, self._beside(before + c) / max(1.0, self._sign(before))) + 0.3 * p) if before else log(p)
                    if top is None or s + likely > top[0]:
                        top = (s + likely, path)
                new[c] = (top[0] + channel, (top[1], c))  # type: ignore[index]
            best = new
        _, path = max(best.values(), key=lambda x: x[0])
        out: list[str] = []
        while path:
            path, c = path
            out.append(c)
        return "".join(out[::-1])

    def odd_signs(self, run: str) -> list[int]:
        """Places of rare Chinese characters that neither neighbour is ever beside in unscanned text."""
        if len(run) < 2:
            return []
        joined = [self.count(2, "=" + run[i : i + 2]) >= CLEAN for i in range(len(run) - 1)]
        bad = [i for i in range(len(run)) if not (i and joined[i - 1]) and not (i < len(joined) and joined[i])]
        # A frequent sign stands alone because of a misread neighbour.
        return [i for i in bad if self._sign(run[i]) < RARE * CLEAN]

    def garbled(self, runs: list[str]) -> bool:
        """Whether the Chinese of a row, mended, is no text but bytes read wrongly: many of its signs are rare or not joined."""
        rare = max(CLEAN, 2e-4 * self.signs_total)
        odd = sum(len({*self.odd_signs(run), *(i for i, c in enumerate(run) if self._sign(c) < rare)}) for run in runs)
        return odd > max(1, 0.4 * sum(map(len, runs)))


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = np.zeros(TABLES * SLOTS, np.int32)
    known: dict[str, int] = {}
    every = _cells(2, "=")[0]
    pairs: dict[tuple[str, str], int] = {}
    words: dict[str, int] = {}

    def flush() -> None:
        for (a, b), n in pairs.items():
            for c in _cells(1, a + " " + b):
                table[c] += n
        for w, n in words.items():
            for c in (*_cells(0, w), *(() if w.isdigit() else (c for g in _grams(w) for c in _cells(2, g) + _cells(2, "~" + g[:2])))):
                table[c] += n
        pairs.clear()
        words.clear()

    for frame in frames:
        weight = np.where(frame["source"] == "ocr", 1, CLEAN)
        for text, n in zip(frame["text"], weight.tolist()):
            before = ""
            for w in _TOKEN.findall(text.lower()):
                if w[0] >= "㐀" and _HAN.match(w):
                    for sign in (*w, *map("".join, zip(w, w[1:]))):
                        got = known.get(sign)
                        if got is None:
                            got = known[sign] = _cells(2, "=" + sign)[0]
                        table[got] += n
                    table[every] += len(w) * n
                    before = ""
                    continue
                words[w] = words.get(w, 0) + n
                if before:
                    pairs[before, w] = pairs.get((before, w), 0) + n
                before = w
            if len(pairs) > 400_000:
                flush()
        if len(known) > 500_000:
            known.clear()
    flush()
    slots = np.flatnonzero(table)
    for at in range(0, len(slots), 100_000):
        some = slots[at : at + 100_000]
        yield pd.DataFrame({"cell": some, "n": table[some]})


def language_counts(chunks: DataFrame) -> np.ndarray:
    """Counts over all rows; what reaches the driver is bounded by TABLES * SLOTS cells."""
    rows = chunks.select("text", F.coalesce("source", F.lit("")).alias("source")).where(F.col("text").isNotNull())
    cells = rows.mapInPandas(_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = shared_table(cells, "language").toArrow()
    big = len(found) and found["n"].to_numpy().max() > 2**31 - 1
    counts = np.zeros(TABLES * SLOTS, np.int64 if big else np.int32)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def chance(counts: np.ndarray) -> list[int]:
    """What a cell of each table holds by chance: the upper quartile of its cells."""
    return [int(np.partition(t, 3 * SLOTS // 4)[3 * SLOTS // 4]) for t in counts.reshape(TABLES, SLOTS)]


def confusion_rates(chunks: DataFrame, shared) -> dict[tuple[str, str], float]:
    """Log probability of each confusion (printed, read), estimated from all scanned rows; one row a confusion and one a printed sign reach the driver."""

    def explained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang = Language(*shared.value)
        words: dict[str, int] = {}
        for frame in frames:
            for text in frame["text"]:
                for w in _TOKEN.findall(text.lower()):
                    if not _HAN.match(w):
                        words[w] = words.get(w, 0) + 1
        uses: dict[tuple[str, str], float] = {}
        printed = {a for a, _ in CONFUSIONS}
        for w, n in words.items():
            found = lang.fixes(w)
            part = np.array([lang.word(c)[1] + channel for c, channel in found])
            part = np.exp(part - part.max())
            part /= part.sum()
            for (c, _), share in zip(found, part.tolist()):
                for pair in lang.used.get(w, {}).get(c, ()):
                    uses[pair] = uses.get(pair, 0.0) + share * n
                if share > 0.5:
                    for a in printed:
                        if a in c:
                            uses[a, ""] = uses.get((a, ""), 0.0) + n * c.count(a)
        yield pd.DataFrame([(*k, v) for k, v in uses.items()], columns=["printed", "read", "n"])

    rows = chunks.select("text").where((F.col("source") == "ocr") & F.col("text").isNotNull())
    sums = {(r["printed"], r["read"]): r["n"] for r in rows.mapInPandas(explained, "printed string, read string, n double").groupBy("printed", "read").agg(F.sum("n").alias("n")).collect()}
    start = float(np.exp(CONFUSED))
    return {(a, b): log(min(MOST, (sums.get((a, b), 0.0) + start * WEIGHT) / (sums.get((a, ""), 0.0) + WEIGHT))) for a, b in CONFUSIONS}


def _letters(text: str) -> str:
    return _NO_LETTER.sub("", text.lower())


def is_margin(text: str, page: int | None, titles: list[str]) -> bool:
    """The page's number, the title or both, and nothing else."""
    bare = _NUMBERED.sub(" ", text)
    parts = [p for p in re.split(r"[^\w]+", bare) if p]
    number = str(page) if page is not None else None
    if number:
        rest = [p for p in parts if p.translate(_DIGITS) != number and p.lower() != _roman(page)]
        if not rest and len(parts) == 1:
            return True
        if len(rest) < len(parts) and (parts[0] not in rest or parts[-1] not in rest):
            bare = " ".join(rest)
    letters = _letters(bare)
    if len(letters) < 3:
        return False
    for title in titles:
        short = title[: len(letters) + 1] if len(letters) >= max(4, 0.5 * len(title)) else title
        for t in {title, short}:
            if abs(len(t) - len(letters)) <= 0.3 * len(t) and difflib.SequenceMatcher(None, letters, t, False).ratio() >= 0.8:
                return True
    return False


_ADDED = re.compile(r"(?i)^(?:copy of|copie de|kopie von)\s+|\s*[-–(]*\s*(?:rev|copy|copie|kopie|\d+)\.?\)?\s*$|\.\w{2,4}$")


def _title_forms(title: str | None) -> list[str]:
    if not title:
        return []
    forms = {_letters(title)}
    bare = title.replace("_", " ")
    for _ in range(3):
        bare = _ADDED.sub("", bare)
        forms.add(_letters(bare))
    return [f for f in forms if len(f) >= 3]


def _goes_on(text: str, following: str, lang: Language, standing: set[str]) -> tuple[bool, bool]:
    """Whether the last word of `text` goes on in `following`, and whether its sign is part of the word."""
    tail, head = _TAIL.search(text), _HEAD.match(following)
    if not tail or not head:
        return False, False
    stem, sign, rest = tail[1].lower(), tail[2], head[1].lower()
    last = stem.rpartition("-")[2]
    whole = lang.word(last + rest)
    first, second = lang.word(last), lang.word(rest)
    if not sign:
        # A sign that was lost: neither part is a word by itself, the whole is.
        return whole[0] >= 3 * CLEAN and first[0] < CLEAN and second[0] < CLEAN and len(last) > 1, False
    pair = lang.count(1, last + " " + rest)
    if whole[0] >= CLEAN and whole[0] >= 0.2 * pair:
        return True, False
    if pair >= CLEAN and whole[0] < CLEAN and rest not in standing:
        return True, True
    if rest in standing:
        return False, True
    return True, False


# Words between two that share their second half, after a hyphen that stays.
STANDING = {"and", "or", "to", "und", "oder", "bis", "et", "ou", "à", "и", "или", "y", "e", "o"}


def _repair(text: str, lang: Language) -> tuple[str, bool]:
    """One row with its misread characters corrected, and whether there was any."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    words = [(a, b, w) for a, b, w in tokens if not _HAN.match(w)]
    bad = False
    if len(words) < len(tokens) and not _BROKEN.search(text):
        runs = [(a, w, lang.signs(w)) for a, _, w in tokens if _HAN.match(w)]
        if not lang.garbled([p for _, _, p in runs]):
            for a, w, p in runs:
                bad = bad or p != w or bool(lang.odd_signs(p))
                text = text[:a] + p + text[a + len(p) :]
    if not words:
        return text, bad
    read = [w.lower() for _, _, w in words]
    printed = lang.line(read)
    out, at = [], 0
    for (a, b, w), r, p in zip(words, read, printed):
        if r != p:
            bad = True
            out += [text[at:a], p.upper() if w.isupper() and len(w) > 1 and not any(c.isdigit() for c in w) else p.capitalize() if w[0].isupper() else p]
            at = b
    return "".join([*out, text[at:]]), bad


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters, the one that stands for each, and longer readings with what they are read for: equal for texts a few confusions apart."""
    stands: dict[str, str] = {}

    def find(c: str) -> str:
        while stands.get(c, c) != c:
            c = stands[c]
        return c

    for a, b in CONFUSIONS:
        if len(a) == len(b) == 1:
            stands[find(a.lower())] = find(b.lower())
    letters = "".join(sorted({c for a, b in CONFUSIONS for c in (a + b).lower()}))
    fold = str.maketrans({c: find(c) for c in letters})
    longer = {max(p, key=len).translate(fold): min(p, key=len).translate(fold) for p in CONFUSIONS if len(p[0]) != len(p[1])}
    return letters, letters.translate(fold), list(longer.items())


def _edge_key(text: Column) -> Column:
    """What recurring margin rows have in common: letters up to confusions, without page numbers."""
    letters, folded, longer = _folds()
    key = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}])(?:\p{N}+|[ivxlc]+)(?![\p{L}\p{N}])", "")
    key = F.translate(F.regexp_replace(key, r"[^\p{L}\p{N}]+", ""), letters, folded)
    for a, b in longer:
        key = F.replace(key, F.lit(a), F.lit(b))
    return key


def _repeated(pages: DataFrame) -> DataFrame:
    """(document_id, page, often): for rows at the edges of each page and the next, at how many pages' same edge they stand if several."""
    edges = [pages.select("document_id", "page", F.lit(n).alias("side"), F.explode(part).alias("row")) for n, part in enumerate((F.slice("rows", 1, LOOK), F.reverse(F.slice(F.reverse("rows"), 1, LOOK))))]
    short = edges[0].unionAll(edges[1]).where(F.length("row.text") <= EDGE).select("document_id", "page", "side", F.col("row.id").alias("id"), _edge_key(F.col("row.text")).alias("key"))
    rows = short.where(F.length("key") >= F.when(F.col("key").rlike("[㐀-鿿]"), 2).otherwise(4))
    seen = rows.select("document_id", "side", "key", "page").distinct().groupBy("document_id", "side", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = rows.join(seen, ["document_id", "side", "key"]).select("document_id", F.explode(F.array("page", F.col("page") - 1)).alias("page"), "id", "n")
    return found.groupBy("document_id", "page").agg(F.collect_set(F.struct("id", "n")).alias("often"))


def _pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, page, rows, ahead, behind, often, title): rows of each page and the first LOOK of the pages beside it, in order."""
    number = F.col("page").cast("long")
    page = F.coalesce(number, -2 - F.floor(F.coalesce("ordinal", F.lit(0)) / 64))
    rows = chunks.where((F.col("source") == "ocr") & F.col("text").isNotNull() & F.col("document_id").isNotNull()).select(
        "document_id", page.alias("page"), number.alias("number"), F.coalesce("line", F.lit(0)).alias("line"), "ordinal", "id", "text"
    )
    row = F.struct("line", "ordinal", "id", "number", "text")
    head = rows.where(F.col("line") <= LOOK)
    parts = {"rows": rows, "ahead": head.withColumn("page", F.col("page") - 1), "behind": head.withColumn("page", F.col("page") + 1)}
    none = F.lit(None).cast(rows.select(row).schema[0].dataType)
    sent = [df.select("document_id", "page", *((row if name == other else none).alias(other) for other in parts)) for name, df in parts.items()]
    gathered = (
        sent[0]
        .unionAll(sent[1])
        .unionAll(sent[2])
        .groupBy("document_id", "page")
        .agg(*(F.array_distinct(F.array_sort(F.collect_list(name))).alias(name) for name in parts))
        .where(F.size("rows") > 0)
    )
    pages = shared_table(gathered, "pages")
    titles = documents.select(F.col("id").alias("document_id"), "title").where("document_id is not null")
    return pages.join(_repeated(pages), ["document_id", "page"], "left").join(titles, "document_id", "left")


def _width(text: str) -> int:
    return len(text) + len(_HAN.findall(text))


def is_name(text: str, page: int | None) -> bool:
    """A bare name, two to four words with capitals or so many Chinese characters, with or without the page's number."""
    words = [w for w in text.split() if w.strip("-–—|[]().·") and not (page is not None and is_margin(w, page, []))]
    if len(words) == 1:
        return bool(_HAN_NAME.match(words[0]))
    return 2 <= len(words) <= 4 and all(_NAME.match(w) and (w[0].isupper() or w[0] in "l10") for w in words)


def _peel(rows: list, titles: list[str], head_only: bool = False, often: dict[int, int] | None = None, width: int = 0, beside: bool = False) -> set[int]:
    """Places of the margin rows; `often` says of how many pages' edges a row is, `beside` that a title heads a page beside this one."""

    def stands_alone(i: int, step: int) -> bool:
        text = rows[i]["text"]
        tail = _TAIL.search(text)
        if _END.search(text) or tail and tail[2]:
            return False
        # Running text is broken off only where the next word, of which little is known at the foot, doesn't fit.
        after = rows[i + 1]["text"].split(" ")[0] if step > 0 and i + 1 < len(rows) else ""
        short = _width(text) < 0.75 * width and _width(text) + 1 + (min(_width(after), 12) if after else 12) <= width
        n = (often or {}).get(rows[i]["id"], 1)
        return n > 2 or n == 2 and short or (short or beside and step > 0) and is_name(text, rows[i]["number"])

    found: set[int] = set()
    for step, places in ((1, range(len(rows))), (-1, range(len(rows) - 1, -1, -1)))[: 1 if head_only else 2]:
        for k, i in enumerate(places):
            if k == 3 or not (is_margin(rows[i]["text"], rows[i]["number"], titles) or stands_alone(i, step)):
                break
            found.add(i)
    return found


def _titled(rows: list, titles: list[str]) -> bool:
    """Whether one of the rows at the head of a page is the title."""
    return any(is_margin(r["text"], r["number"], titles) and not is_margin(r["text"], r["number"], []) for r in rows)


def _worked(chunks: DataFrame, documents: DataFrame, text_only: bool) -> DataFrame:
    known = language_counts(chunks)
    counts = chunks.sparkSession.sparkContext.broadcast((known, chance(known)))
    rates = confusion_rates(chunks, counts)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang = Language(*counts.value, rates)
        for frame in frames:
            out = []
            for doc, page, rows, ahead, behind, often, title in zip(*(frame[c] for c in ("document_id", "page", "rows", "ahead", "behind", "often", "title"))):
                titles = _title_forms(title)
                rows, overleaf = list(rows), list(ahead)
                often = {r["id"]: r["n"] for r in often} if often is not None else {}
                width = max(_width(r["text"]) for r in [*rows, *overleaf])
                margins = _peel(rows, titles, False, often, width, _titled(overleaf, titles) or _titled(list(behind), titles))
                skipped = _peel(overleaf, titles, True, often, width, _titled(rows[:LOOK], titles))
                running = [(r["id"], r["text"]) for i, r in enumerate(rows) if i not in margins]
                following = [r["text"] for i, r in enumerate(overleaf) if i not in skipped][:1]
                texts = [t for _, t in running] + following
                if not text_only:
                    out += [(rows[i]["id"], "margin") for i in margins]
                page_text = ""
                for k, (i, t) in enumerate(running):
                    on, keep = _goes_on(t, texts[k + 1], lang, STANDING) if k + 1 < len(texts) else (False, False)
                    # Parts of a broken word are judged together.
                    plain, rest = t, ""
                    if k and joined:
                        head = _HEAD.match(t)
                        plain = t[head.end() :] if head else t
                        rest = head[0].strip() if head else ""
                    tail = _TAIL.search(plain) if on else None
                    body = plain[: tail.start()] if tail else plain
                    fixed, bad = _repair(body, lang)
                    stem = tail[1] if tail else ""
                    if stem:
                        head = _HEAD.match(texts[k + 1])
                        whole = stem + ("-" if keep else "") + head[1]
                        mended, wrong = _repair(whole, lang)
                        # The part in this row is misread if it differs in the mended word.
                        if wrong and mended[: len(stem)].lower() != stem.lower():
                            bad = True
                            if len(mended) >= len(stem):
                                stem = mended[: len(stem)]
                        fixed += stem + ("-" if keep else "") + "\x01"
                    if not text_only:
                        out += [(i, "hyphen")] * on + [(i, "misread")] * bad
                    ends = bool(_END.search(t)) and len(t) < 0.75 * max(len(x) for _, x in running)
                    page_text += rest + fixed + ("" if stem else "\n\n" if ends else " ")
                    joined = on
                if text_only:
                    out.append((doc, page, page_text.strip(" ")))
            yield pd.DataFrame(out, columns=["document_id", "page", "text"] if text_only else ["chunk_id", "defect"])

    return _pages(chunks, documents).mapInPandas(work, "document_id string, page long, text string" if text_only else "chunk_id long, defect string")


def scan_defects(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, defect): margin, hyphen and misread rows of scanned pages."""
    return _worked(chunks, documents, False).distinct()


def scan_paragraphs(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, part, text): scanned documents as paragraphs, a blank line between them; a part holds PART pages."""
    pages = _worked(chunks, documents, True)
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    parts = pages.groupBy("document_id", F.floor(F.col("page") / PART).cast("int").alias("part")).agg(F.transform(ordered, lambda x: x["text"]).alias("pages"))
    # A page that ends inside a word or a paragraph goes on with the next.
    text = F.regexp_replace(F.array_join("pages", " "), "\x01\\s*", "")
    return parts.select("document_id", "part", F.trim(F.regexp_replace(text, r"\n\n\s+", "\n\n")).alias("text"))
