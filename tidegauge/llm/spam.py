"""Documents that are keyword stuffing, link lists or product tags rather than sentences.

Method: block-wise compression ratio, normalized by length and language, flags extreme redundancy,
and a low density of sentence punctuation confirms it. Two additions give the required result,
because lists of distinct links or tags are hardly more redundant than speech and stuffing may
come with full stops. First, a second normalized ratio: blocks without sentences or with links are
compressed with a dictionary of ordinary blocks and with one of redundant blocks of their language,
and the difference flags lists of links and tags but not division lists and agendas. Second, what
confirms a flagged block depends on it: the share of links, or, where it has sentence punctuation,
how much of it repeats a word pair three times or more, sentences repeated whole (formulas)
counting once. No block counts that neither ratio flags. A document is found if such blocks hold
more than half of its text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a block, and least bytes for a ratio to mean anything.
BLOCK, LEAST = 320, 40
#: Blocks of the sample the dictionaries are fitted on, and bytes of a dictionary.
SAMPLE_BLOCKS, DICTIONARY_BYTES = 50_000, 160_000
#: Blocks of a language and length class, and blocks of a language in the sample, from which it has norms and
#: dictionaries of its own; below, those of all languages hold.
LEAST_NORM = 200
#: Robust deviations of the ratio: for a fitting block, a redundant one, and a suspicious one.
SEED, REDUNDANT, SUSPECT = -4.0, -4.0, -1.5
#: Sentence ends in 100 characters under which a block has no sentences.
NO_SENTENCES = 0.35
#: Gain of the dictionary of redundant blocks from which a block without sentences is a tag list.
LIST_GAIN = -0.03
#: Share of words in repeated pairs that confirms stuffing, and of characters in links.
STUFFED, LINKED = 0.33, 0.5
#: Share of words in keywords of the same text from which a suspicious block is stuffing too, and share of words
#: in repeated pairs from which all suspicious blocks of a text are, taken as one.
TOUCHED, TOGETHER = 0.2, 0.25
#: Letters from which a word alone, if it occurs four times, is a keyword.
LONG = 8
#: Gain from which a block without sentences counts if it is a list, or beside spam blocks.
BESIDE = -0.12
ROUNDS = 3

#: A block ends at the last line or sentence end within ``BLOCK`` characters, else at the first within twice
#: as many, else behind a blank, else anywhere.
_END_OF_PIECE = r"(?:\n+|(?<=[.!?])\s+|\Z)"
_BLOCKS = re.compile(
    rf"[\s\S]{{1,{BLOCK}}}{_END_OF_PIECE}|[\s\S]{{1,{2 * BLOCK}}}?{_END_OF_PIECE}"
    rf"|[\s\S]{{{BLOCK // 2},{BLOCK - 1}}} |[\s\S]{{1,{BLOCK}}}"
)
_SPACED = re.compile(r"(?<!\S)\S \S \S \S \S(?!\S)")
_DIGIT_IN_WORD = re.compile(r"[013457@$](?:(?<=[^\W\d_].)|(?=[^\W\d_]))")
_LETTERS_AND_DIGITS = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])[\w@$]*[013457@$][\w@$]*")
_PLAIN = str.maketrans("013457@$", "oieastas")
_BLANKS = re.compile(r"[ \t\xa0]{2,}|[\t\xa0]")
_QUOTES = frozenset("“„«\"")
_QUOTED = re.compile(r"“[^”]{30,}”|„[^“”]{30,}[“”]|«[^»]{30,}»|(?<![=\w/])\"[^\"\n]{30,}\"")
_END = re.compile(r"(?<=[^\W_][^\W_])[\"”»)]?[.!?](?=\s|$)")
_DOTTED = re.compile(r"[.:\]<](?:[a-z]|//|\(|\])")
_NUMBER_IN_FRONT = re.compile(r"(?m)^\s*\d{1,3}[.)]\s")
_SEPARATOR = re.compile(r"[\n,;|/•>]|\s[-–—]\s|\d(?= )")
#: An address, or a host: labels joined by points, also spelled out or set apart, the last of letters only.
_POINT = r"(?:\.| \. | ?\bdot\b ?| ?\[\.\] ?)"
_LINK = re.compile(
    rf"(?:h(?:tt|xx)ps?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*"
    rf"|\b[\w-]+(?:{_POINT}[\w-]+)*{_POINT}[a-z]{{2,24}}\b(?:/\S*)?"
)
_ANCHOR = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|<a\b[^>\n]*>[^<\n]*</a>")
_ASIDE = re.compile(r"\([^()\d]{0,200}\)|\[[^\[\]]{0,200}\](?!\()")
_NUMBERED = re.compile(r"\s*\d{1,3}[.)]\s")
_ITEM = re.compile(r"[\n,;|/•·–—+*>()\[\]:=&?!.¿¡\"“”#]+|\s-\s|\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCES, _CLAUSES, _NO_LETTERS = re.compile(r"(?<=[.!?])\s+|\n+"), re.compile(r"(?<=[,;:])\s+"), re.compile(r"[\W\d_]+")
_FIGURES = re.compile(r"(?:[|\t;]|\s{2,})\s*[\d.,]+\s*%?(?=\s*(?:[|\t;]|\s{2,}|$))")
_MEMBER = re.compile(r"\([a-z]{2,4}\.?\)")


_PACK = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def plain(text: str) -> str:
    """Lower case, with letters set apart by blanks joined and digits in words read as letters."""
    if text.count(" ") * 3 > len(text) and len(_SPACED.findall(text)) * 20 > len(text):
        text = re.sub(r"(?<=\S) (?=\S)", "", text)
    text = text.lower()
    if _DIGIT_IN_WORD.search(text):
        text = _LETTERS_AND_DIGITS.sub(lambda m: m.group().translate(_PLAIN) if sum(c.isalpha() for c in m.group()) >= 2 else m.group(), text)
    return _BLANKS.sub(" ", text) if "  " in text or "\t" in text or "\xa0" in text else text


def blocks_of(text: str) -> list[str]:
    """The text cut at sentences and lines into blocks of about ``BLOCK`` characters."""
    return [b for b in _BLOCKS.findall(text) if not b.isspace()]


def ratio_of(block: str) -> tuple[int, float]:
    """Bytes of a block and its compression ratio without the fixed frame."""
    raw = block.encode("utf-8")
    return len(raw), len(_PACK.compress(raw)) / len(raw)


def length_class(n: int) -> int:
    return int(math.log2(max(n, 1)) * 2)


def sentence_density(block: str) -> float:
    """Sentence ends in 100 characters."""
    if "\n" in block:
        block = _NUMBER_IN_FRONT.sub("", block)
    return 100.0 * len(_END.findall(block)) / max(1, len(block))


def link_share(block: str) -> float:
    """Share of the characters of a block in links with their anchors, or in lines mostly link."""
    n = 0

    def take(m: re.Match) -> str:
        nonlocal n
        n += len(m.group())
        return " "

    for line in _ANCHOR.sub(take, block).split("\n"):
        links = sum(map(len, _LINK.findall(line)))
        listed = links > 0.25 * len(line) and not _END.search(_LINK.sub(" ", line))
        n += len(line) if listed else links
    return min(1.0, n / max(1, len(block)))


def is_broken(block: str) -> bool:
    """Text of hardly any words or characters, as a stuck key or a failed scan leaves it."""
    return len(set(block)) < 7 or len(set(_WORD.findall(block))) < 2


def figure_share(block: str) -> float:
    """Share of the characters of a block in rows of figures."""
    lines = [x for x in block.split("\n") if x.strip()]
    return sum(len(x) for x in lines if len(_FIGURES.findall(x)) >= 2) / max(1, sum(map(len, lines)))


def _grams(block: str) -> tuple[list[tuple[int, int, str]], int]:
    """Word pairs, and words that stand alone or are long, of a block, and its number of words.

    Each comes with the number of its sentence (-1 outside sentences) and its place. Links and
    asides are left out; sentences, clauses of four words and more, and numbered lines that are
    repeated whole count once.
    """
    text = _LINK.sub(" | ", block) if _DOTTED.search(block) or " dot " in block or " . " in block else block
    text = _ASIDE.sub(" ", text) if "(" in text or "[" in text else text
    seen: set[str] = set()
    places = []
    n = 0
    for k, s in enumerate(_SENTENCES.split(text)):
        ended = s.rstrip()[-1:] in (".", "!", "?")
        whole = _NO_LETTERS.sub(" ", s).strip()
        if (ended or _NUMBERED.match(s)) and whole in seen:
            continue
        seen.add(whole)
        for clause in _CLAUSES.split(s) if ended else [s]:
            key = _NO_LETTERS.sub(" ", clause).strip() if ended else whole
            if key != whole and key.count(" ") >= 3:
                if key in seen:
                    continue
                seen.add(key)
            for item in _ITEM.split(clause):
                words = _WORD.findall(item)
                at = k if ended else -1
                if len(words) == 1:
                    places.append((at, n, words[0]))
                else:
                    places += [(at, n + i, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
                    places += [(at, n + i, w) for i, w in enumerate(words) if len(w) >= LONG]
                n += len(words)
    return places, n


def stuffing(block: str, keywords: frozenset[str] = frozenset()) -> tuple[float, frozenset[str]]:
    """Share of the words of a block in word pairs repeated as keywords are, or in ``keywords``.

    A pair is a keyword if it occurs three times, at least twice in one sentence: formulas come
    once in each. A word alone must occur four times. Also returns the block's keywords.
    """
    places, n = _grams(block)
    counts = Counter(g for _, _, g in places)
    twice = {g for (_, g), k in Counter((s, g) for s, _, g in places).items() if k >= 2}
    often = frozenset(g for g in twice if counts[g] >= 3 + (" " not in g))
    if n < 8:
        return 0.0, often
    covered = np.zeros(n, bool)
    for _, at, g in places:
        if g in often or g in keywords:
            covered[at : at + 1 + (" " in g)] = True
    return float(covered.mean()), often


class Gain:
    """How much better a block compresses after redundant blocks than after ordinary ones."""

    def __init__(self, redundant: bytes, ordinary: bytes) -> None:
        self.parts = []
        for data in (redundant, ordinary):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.parts.append(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, block: str) -> float:
        raw = block.encode("utf-8")
        redundant, ordinary = (len(c.compress(raw)) for c in self.parts)
        return (ordinary - redundant) / len(raw)


class Judge:
    """Norms by (language, length class) and dictionaries by (language, fold)."""

    def __init__(self, norms: dict[tuple[str, int], tuple[float, float]], dictionaries: dict[tuple[str, int], tuple[bytes, bytes]]) -> None:
        self.norms, self.dictionaries = norms, dictionaries
        self._gains: dict[tuple[str, int], Gain] = {}

    def __getstate__(self) -> dict:
        return {"norms": self.norms, "dictionaries": self.dictionaries, "_gains": {}}

    def deviation(self, lang: str, n: int, ratio: float) -> float:
        """Robust deviations of a ratio from blocks of its language and length."""
        middle, spread = self.norms.get((lang, length_class(n))) or self.norms.get(("", length_class(n))) or (0.55, 0.05)
        return (ratio - middle) / spread

    def gain(self, lang: str, fold: int, block: str) -> float:
        key = (lang, fold) if (lang, fold) in self.dictionaries else ("", fold)
        if key not in self.dictionaries:
            return 0.0
        if key not in self._gains:
            self._gains[key] = Gain(*self.dictionaries[key])
        return self._gains[key](block)

    def verdict(self, lang: str, fold: int, block: str) -> tuple[bool | None, frozenset[str]]:
        """Whether a block is stuffing, links or tags; None where it is suspicious; its keywords."""
        none: frozenset[str] = frozenset()
        n, ratio = ratio_of(block)
        off = self.deviation(lang, n, ratio)
        dotted = " dot " in block or " . " in block or _DOTTED.search(block) is not None
        ends = block.count(". ") + block.count("? ") + block.count("! ")
        if off >= SUSPECT and not dotted and ends * 70 > NO_SENTENCES * len(block):
            return False, none  # the ordinary case, told without the costlier measures
        kept = block
        if not _QUOTES.isdisjoint(block):
            kept = _QUOTED.sub(" ", block)
            if len(kept) < 0.5 * len(block):
                return False, none
            if kept != block:
                n, ratio = ratio_of(kept)
                off = self.deviation(lang, n, ratio)
        ended = sentence_density(kept) >= NO_SENTENCES
        if ended and off >= SUSPECT and not dotted:
            return False, none
        if n < LEAST or is_broken(kept):
            return False, none
        # Flagged by its own normalized ratio or, where there are no sentences, by that with dictionaries.
        gain = self.gain(lang, fold, kept) if dotted or not ended else -1.0
        if dotted and (off < SUSPECT or gain > BESIDE) and link_share(kept) >= LINKED:
            return True, none
        if ended and off >= SUSPECT:
            return False, none
        if n - len(_ASIDE.sub("", kept).encode("utf-8")) > n / 2:
            return False, none
        agenda = sum(bool(_NUMBERED.match(x)) for x in kept.split("\n")) * 60 > len(kept)
        if agenda or figure_share(kept) > 0.5 or len(_MEMBER.findall(kept)) * 40 > len(kept):
            return False, none
        if ended or off < REDUNDANT:
            stuffed, keywords = stuffing(kept)
            if stuffed >= STUFFED:
                return True, keywords
            if ended:
                return None, none
        listed = len(_SEPARATOR.findall(kept)) * 60 > len(kept)
        return (True, none) if gain > LIST_GAIN or (listed and gain > BESIDE) else (None, none)


def spam_share(judge: Judge, lang: str, fold: int, text: str) -> float:
    """Share of the characters of a text in blocks that are spam.

    A suspicious block also counts where the keywords of the text's spam blocks cover enough of it,
    and where most of the text is suspicious and confirmed when taken as one.
    """
    parts = blocks_of(plain(text))
    verdicts = [judge.verdict(lang, fold, b) for b in parts]
    keywords = frozenset().union(*(k for v, k in verdicts if v))
    spam = any(v for v, _ in verdicts)

    def beside(b: str) -> bool:
        if keywords and stuffing(b, keywords)[0] >= TOUCHED:
            return True
        return sentence_density(b) < NO_SENTENCES and judge.gain(lang, fold, b) > BESIDE

    size = max(1, sum(map(len, parts)))
    bad = sum(len(b) for b, (v, _) in zip(parts, verdicts, strict=True) if v or (v is None and spam and beside(b)))
    flagged = [b for b, (v, _) in zip(parts, verdicts, strict=True) if v is not False]
    together = sum(map(len, flagged))
    if bad * 2 <= size < together * 2:
        # Most of the text is flagged and too little confirmed block by block: confirmed as one text, or not.
        text = "\n".join(flagged)
        stuffed = stuffing(text)[0]
        confirmed = stuffed >= TOUCHED or sentence_density(text) < NO_SENTENCES
        if stuffed >= TOGETHER or (confirmed and judge.gain(lang, fold, text) > BESIDE):
            bad = together
    return bad / size


def fit_dictionaries(sample: list[tuple[str, int, str]], norms: dict) -> dict[tuple[str, int], tuple[bytes, bytes]]:
    """Dictionaries for each language and fold from a bounded sample of (language, fold, block).

    First the redundant blocks without sentences, and the linked ones, are one side; then blocks
    move to the side whose dictionary, made of the other fold, compresses them better.
    """
    judge = Judge(norms, {})
    facts = []
    for lang, fold, block in sample:
        if sentence_density(block) >= NO_SENTENCES:
            facts.append((False, False, False))
            continue
        n, ratio = ratio_of(block)
        broken = n < LEAST or is_broken(block) or figure_share(block) > 0.5
        linked = link_share(block) >= LINKED
        facts.append((not broken and (linked or judge.deviation(lang, n, ratio) < SEED), True, broken))
    side = [f[0] for f in facts]
    langs = {x for x, n in Counter(x[0] for x in sample).items() if n >= LEAST_NORM} | {""}
    out: dict[tuple[str, int], tuple[bytes, bytes]] = {}
    for _ in range(ROUNDS):
        out = {}
        for lang in langs:
            for fold in (0, 1):
                data = []
                for want in (True, False):
                    chosen, size = [], 0
                    for (bl, bf, block), s, (_, _, broken) in zip(sample, side, facts, strict=True):
                        if s is want and bf != fold and (bl == lang or not lang) and not (want and broken):
                            raw = block.encode("utf-8")
                            if size + len(raw) > DICTIONARY_BYTES:
                                break
                            chosen.append(raw)
                            size += len(raw) + 1
                    data.append(b"\n".join(chosen))
                if all(len(x) >= 1000 for x in data):
                    out[lang, fold] = (data[0], data[1])
        judge = Judge(norms, out)
        side = [flat and not broken and judge.gain(lang, fold, block) > 0.03 for (lang, fold, block), (_, flat, broken) in zip(sample, facts, strict=True)]
    return out


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by language, length class and ratio in hundredths, counted in the task."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                for b in blocks_of(plain(text)):
                    n, ratio = ratio_of(b)
                    if n >= LEAST:
                        counts[lang, length_class(n), int(ratio * 100)] += 1
    rows = [(*k, v) for k, v in counts.items()]
    names = ["lang", "klass", "bin", "n"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)


def _histograms(counts: DataFrame) -> list:
    """Histograms of each (language, length class) of ``LEAST_NORM`` blocks, and of each class over all ("")."""
    each = counts.groupBy("lang", "klass", "bin").agg(F.sum("n").alias("n"))
    size = F.sum("n").over(Window.partitionBy("lang", "klass"))
    own = each.withColumn("size", size).filter(F.col("size") >= LEAST_NORM).drop("size")
    whole = each.groupBy("klass", "bin").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "klass", "bin", "n")
    return own.unionByName(whole).collect()  # languages x lengths x ratios


def _norms(rows: list) -> dict[tuple[str, int], tuple[float, float]]:
    """Median and robust spread of the ratio for each histogram."""
    groups: dict[tuple[str, int], Counter] = {}
    for r in rows:
        groups.setdefault((r.lang, r.klass), Counter())[r.bin] += r.n
    out = {}
    for key, counts in groups.items():
        bins = np.array(sorted(counts))
        n = np.array([counts[b] for b in bins])

        def middle(values: np.ndarray, n: np.ndarray = n) -> float:
            order = np.argsort(values, kind="stable")
            upto = np.cumsum(n[order])
            return float(values[order][np.searchsorted(upto, upto[-1] / 2)])

        m = middle(bins / 100 + 0.005)
        out[key] = (m, 1.4826 * middle(np.abs(bins / 100 + 0.005 - m)) + 0.01)
    return out


def _sample_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, fold, b) for lang, fold, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "fold", "text")), strict=True) if text for b in blocks_of(plain(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.string(), pa.int32(), pa.string()))], names=["lang", "fold", "block"])


def _shares(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            share = [spam_share(judge, lang, fold, text) if text else 0.0 for lang, fold, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "fold", "text")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(share, pa.float64())], names=["doc_id", "spam_share"])

    return score


def spam_shares(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``spam_share``, the share of each text in blocks that are spam.

    A NULL, empty or blank text has share 0, as has a broken one of few distinct characters. A
    NULL language counts as one of its own; one with too few blocks is judged by the norms of all.
    Texts of any length are judged whole; repeated rows give equal rows; an empty table gives no
    rows; other columns are ignored. The norms are taken over all blocks; the dictionaries are
    fitted on at most ``SAMPLE_BLOCKS`` blocks.
    """
    spark = documents.sparkSession
    docs = documents.select(
        "doc_id",
        F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"),
    )
    rows = _histograms(docs.select("lang", "text").mapInArrow(_histogram, "lang string, klass int, bin int, n bigint"))
    norms = _norms(rows)
    total = sum(r.n for r in rows if not r.lang)
    part = min(1.0, 1.1 * SAMPLE_BLOCKS / max(1, total))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    blocks = drawn.select("lang", "fold", "text").mapInArrow(_sample_blocks, "lang string, fold int, block string")
    sample = blocks.orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).toArrow().to_pylist()
    judge = Judge(norms, fit_dictionaries([(r["lang"], r["fold"], r["block"]) for r in sample], norms))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shares = _shares(spark.sparkContext.broadcast(judge))
    return docs.select("doc_id", "lang", "fold", "text").mapInArrow(shares, f"doc_id {kind}, spam_share double")


def spam_documents(documents: DataFrame) -> DataFrame:
    """The ``doc_id`` of each document more than half of whose text is spam."""
    return spam_shares(documents).filter("spam_share > 0.5").select("doc_id")
