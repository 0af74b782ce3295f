"""Problem 8: text that was decoded with the wrong character encoding.

A chain (wrong, right) means: the bytes were written in ``right`` and read as ``wrong``.  Two models
are fitted on texts that show no trace of damage:

* a multinomial classifier over hashed byte bigrams of records garbled on purpose, one class per
  chain and one for intact text, whose posterior says which chain made a piece of text;
* counts of neighbouring characters of the undamaged texts, which say how usual a spelling is.

Every word beyond ASCII is put through the inverse of every chain that can have made it and that the
classifier does not rule out; words whose spelling gains by a clear margin, alone or together with
their sentence, mark damage. The classifier's likeliest chain is then undone for the whole text or the
sentence, if that is strictly decodable and its result sane and more usual; else what the words found
alone stays.  Inversions are repeated, so doubly garbled text comes back too.  Replacement characters
and C1 controls are damage that cannot be read as anything else; where no chain gives them back the
text is reported without a restoration.

Physical plan: counting is map-side in numpy with one small shuffle of bucket sums; the models have
a fixed number of buckets, so what is broadcast does not grow with the data; scoring is one stage
over evenly dealt texts.  The neighbour counts cover all rows; the classifier is fitted on at most about
``TRAIN_DOCUMENTS`` rows, chosen by a hash of the id, which is a parameter.

Defined cases: null, empty and pure ASCII texts are no cases; a text is judged by its own
characters only, whatever language it claims; repeated rows are judged alike; an empty table gives
an empty result; very long texts are judged whole, word by word.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TRAIN_DOCUMENTS = 2_000
PAIR_BUCKETS = 1 << 18
CHAR_BUCKETS = 1 << 16
BIGRAM_BUCKETS = 1 << 14
# What a chain loses of its gain for each unit of log-likelihood that it is behind the likeliest.
PRIOR = 1.0
# Log-odds of the likeliest chain against intact text that decide on a piece, where its words speak for
# damage too and where they do not; how far behind it a chain may be to count as nearly as likely.
ODDS, ODDS_ALONE, NEAR = 3.0, 8.0, 3.0
DOUBT = 2.0  # gain of a word by some chain from which on the classifier is asked about the text
WORD_CACHE = 200_000
GATHER = 20_000  # characters scored at once

_SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r")
_RIGHT = ("cp1252", "cp1250", "cp1251", "cp1254", "mac_roman", "cp850", "cp866", "koi8_r", "iso8859_2", "gbk", "euc_jp", "cp932")
CHAINS: tuple[tuple[str, str], ...] = tuple(
    [(w, "utf-8") for w in (*_SINGLE, "cp1254", "cp866", "iso8859_2", "iso8859_15", "gbk", "cp932")]
    + [(w, r) for r in _RIGHT for w in _SINGLE if w != r and {w, r} != {"cp1252", "latin-1"} and {w, r} != {"cp1254", "cp1252"}]
    + [("cp1252", "cp1254"), ("latin-1", "cp1254")]
)
CHAINS = tuple(dict.fromkeys(CHAINS))
_SPACE = re.compile(r"[ \t\r\n]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])[ \t\r\n]+|\n|(?<=[。！？，、])")
# A whole character of UTF-8 among bytes that stand one to a character.
_UTF8_CHAR = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_KEEP_SPACE, _KEEP_SENTENCE = (re.compile(f"({p.pattern})") for p in (_SPACE, _SENTENCE))
_BESIDE = re.compile(r"[^\x00-\x7f]{2,}")
_AGAINST = 4.0
# Latin beside Greek or Cyrillic, or around an ideograph, within a word: no sane restoration
# brings that in.
_MIXED = re.compile("[A-Za-z\xc0-\u024f][\u0370-\u052f]|[\u0370-\u052f][A-Za-z\xc0-\u024f]|[a-z][\u4e00-\u9fff]{1,4}[a-z]")
_LOST = re.compile("[�\x80-\x9f]")


@lru_cache(maxsize=64)
def _table(name: str) -> tuple[str, object]:
    """Decoding table and encoding map of a single-byte encoding; bytes it leaves undefined stand
    for themselves, as lenient readers have it."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    table = "".join(chars)
    return table, codecs.charmap_build(table)


_EAST_ASIA = ("gbk", "euc_jp", "cp932")


def _multibyte(name: str) -> bool:
    return name == "utf-8" or name in _EAST_ASIA


def _encode(text: str, name: str) -> bytes:
    return text.encode(name) if _multibyte(name) else codecs.charmap_encode(text, "strict", _table(name)[1])[0]


def _decode(data: bytes, name: str) -> str:
    return data.decode(name) if _multibyte(name) else codecs.charmap_decode(data, "strict", _table(name)[0])[0]


def garble(text: str, chain: tuple[str, str]) -> str | None:
    """``text`` as the chain would have left it, None where it cannot."""
    try:
        return _decode(_encode(text, chain[1]), chain[0])
    except UnicodeError:
        return None


def restore(text: str, chain: tuple[str, str]) -> str | None:
    """Inverse of ``garble``: None unless strictly decodable and the chain gives ``text`` back."""
    try:
        out = _decode(_encode(text, chain[0]), chain[1])
    except UnicodeError:
        return None
    return out if out != text and garble(out, chain) == text else None


@lru_cache(maxsize=64)
def _as_bytes(name: str) -> dict[int, int]:
    """Translation of the characters of a single-byte encoding to the code points of their bytes;
    characters outside it become ones that match nothing."""

    class Map(dict):
        def __missing__(self, point: int) -> int:
            return point if point < 128 else 0x100

    return Map({ord(c): b for b, c in enumerate(_table(name)[0])})


def restore_parts(text: str, wrong: str) -> str | None:
    """``text`` with every run of characters read back that strictly is a character of UTF-8
    seen through ``wrong``; the rest stays. None where there is none."""
    seen = text.translate(_as_bytes(wrong))
    out, at = [], 0
    for m in _UTF8_CHAR.finditer(seen):
        try:
            c = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if c < "\xa0":
            continue
        out += [text[at : m.start()], c]
        at = m.end()
    return "".join(out) + text[at:] if at else None


# Letters of Latin beyond ASCII in the larger orthographies of Europe (fixed values).
_LATIN = "āăąćčďđēėęěğģīįıķļłńņňőœŕřśşšţťūůűųźżžĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĻŁŃŅŇŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
# Characters that texts of the world's larger scripts are full of; what reads back as another one
# is more likely a chance meeting of two letters than damage.
_COMMON = re.compile(
    f"[\xa0-\xff{_LATIN}\u0391-\u03c9\u0401-\u0451\u2010-\u2044\u20ac\u2122\u2190-\u22ff\u3000-\u30ff"
    "\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff60\U0001f300-\U0001faff]"
)


@lru_cache(maxsize=64)
def _seen_utf8(wrong: str) -> re.Pattern:
    """A lead byte of UTF-8 and a byte that goes on from it, as ``wrong`` shows them."""
    table = _table(wrong)[0]
    return re.compile(f"[{re.escape(table[0xC2:0xF5])}][{re.escape(table[0x80:0xC0])}]")


def _utf8_inside(text: str) -> bool:
    """Some characters read strictly as common ones of UTF-8 through a single-byte encoding."""
    # a character of UTF-8 shows as two or more characters beyond ASCII side by side
    text = " ".join(_BESIDE.findall(text))
    if not text:
        return False
    for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"):
        if not _seen_utf8(w).search(text):
            continue
        for m in _UTF8_CHAR.finditer(text.translate(_as_bytes(w))):
            try:
                if _COMMON.match(m.group().encode("latin-1").decode("utf-8")):
                    return True
            except UnicodeDecodeError:
                pass
    return False


def _points(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where((x >= 48) & (x <= 57), 48, x)


def _pairs(x: np.ndarray) -> np.ndarray:
    return ((x[:-1] * 0x9E3779B1) ^ (x[1:] * 0x85EBCA77) ^ (x[:-1] >> 3)) % PAIR_BUCKETS


def _byte_bigrams(text: str) -> np.ndarray:
    """Hashed bigrams of UTF-8 bytes, those with a byte beyond ASCII."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    a, c = b[:-1], b[1:]
    return ((a * 251 + c) * 0x9E3779B1 >> 7)[(a | c) >= 128] % BIGRAM_BUCKETS


def _byte_bigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of texts that are not all ASCII, one after the other, and where each text's begin."""
    raw = [f" {t} ".encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    a, c = b[:-1], b[1:]
    keep = (a | c) >= 128  # never across two texts: these meet in two spaces
    n = np.cumsum(keep)
    starts = np.cumsum([0] + [len(r) for r in raw[:-1]])
    return (((a * 251 + c) * 0x9E3779B1 >> 7) % BIGRAM_BUCKETS)[keep], np.r_[0, n][starts]


def _count_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pair, char = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(CHAR_BUCKETS, np.int64)
    for b in batches:
        texts = [" " + _SPACE.sub(" ", t) + " " for t in b["text"] if t and not _LOST.search(t) and not _utf8_inside(t)]
        for i in range(0, len(texts), 500):
            # texts end and begin with a space, so gluing them adds only pairs of spaces
            x = _points("".join(texts[i : i + 500]))
            pair += np.bincount(_pairs(x), minlength=PAIR_BUCKETS)
            char += np.bincount(x % CHAR_BUCKETS, minlength=CHAR_BUCKETS)
    for kind, c in (("pair", pair), ("char", char)):
        at = np.flatnonzero(c)
        yield pd.DataFrame({"kind": kind, "bucket": at, "n": c[at]})


def _count_garbled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((len(CHAINS) + 1, BIGRAM_BUCKETS), np.int64)  # the last class is intact text
    for b in batches:
        texts = [t for t in b["text"] if t and not t.isascii() and not _LOST.search(t) and not _utf8_inside(t)]
        for k in range(0, len(texts), 200):
            sentences = [s for t in texts[k : k + 200] for s in _SENTENCE.split(t) if not s.isascii()]
            if sentences:
                counts[-1] += np.bincount(_byte_bigrams(" " + "  ".join(sentences) + " "), minlength=BIGRAM_BUCKETS)
            for i, chain in enumerate(CHAINS):
                made = [g for s in sentences if (g := garble(s, chain)) is not None and g != s]
                if made:
                    # spaces between the sentences: no bigram beyond ASCII reaches across
                    counts[i] += np.bincount(_byte_bigrams(" " + "  ".join(made) + " "), minlength=BIGRAM_BUCKETS)
    for i in range(len(CHAINS) + 1):
        at = np.flatnonzero(counts[i])
        yield pd.DataFrame({"kind": str(i), "bucket": at, "n": counts[i][at]})


class Models:
    """Scores of both models; a fixed size whatever the data."""

    def __init__(self, rows: pd.DataFrame):
        def vector(kind: str, size: int) -> np.ndarray:
            r = rows[rows["kind"] == kind]
            out = np.zeros(size)
            out[r["bucket"].to_numpy(np.int64)] = r["n"].to_numpy()
            return out

        self.pair = vector("pair", PAIR_BUCKETS)
        self.char = vector("char", CHAR_BUCKETS)
        bigrams = np.stack([vector(str(i), BIGRAM_BUCKETS) for i in range(len(CHAINS) + 1)])
        total = bigrams.sum(axis=1, keepdims=True)
        self.chain = np.log((bigrams + 0.05) / (total + 0.05 * BIGRAM_BUCKETS)).astype(np.float32).T.copy()
        self.known = total[:, 0] > 0
        self.char_total = self.char.sum()
        self._rares: dict[str, bool] = {}

    def usual(self, text: str) -> float:
        """Log-probability of a text's neighbours, spaces at both ends."""
        return float(self.usual_of([text])[0][0])

    def usual_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text: its log-probability, the part of it that pairs with a character beyond ASCII
        have, and whether some character is no commoner than one in ten million."""
        x = _points(f" {' '.join(texts)} ")
        size = np.array([len(t) + 1 for t in texts])  # a text's pairs begin at the space before it
        at = np.cumsum(size) - size
        p = (self.char[x[1:] % CHAR_BUCKETS] + 0.02) / (self.char_total + 0.02 * CHAR_BUCKETS)
        pair = np.log((self.pair[_pairs(x)] + p) / (self.char[x[:-1] % CHAR_BUCKETS] + 1.0))
        beyond = (x[:-1] >= 128) | (x[1:] >= 128)
        odd = (x[:-1] >= 128) & (self.char[x[:-1] % CHAR_BUCKETS] <= self.char_total * 1e-7)
        return np.add.reduceat(pair, at), np.add.reduceat(np.where(beyond, pair, 0.0), at), np.logical_or.reduceat(odd, at)

    def _rare(self, c: str) -> bool:
        if c not in self._rares:
            self._rares[c] = bool(self.char[ord(c) % CHAR_BUCKETS] <= self.char_total * 1e-7)
        return self._rares[c]

    def strange(self, text: str, beside: str) -> bool:
        """Some character below the scripts of East Asia and the pictographs, not in ``beside``, is no
        commoner than one in ten million."""
        return any("\x80" <= c < "\u3000" and c not in beside and self._rare(c) for c in text)

    def behind(self, texts: list[str]) -> np.ndarray:
        """(texts, chains and intact text): how far each class's log-likelihood is behind that of the
        likeliest; infinite for chains the classifier has never seen."""
        out = np.empty((len(texts), len(CHAINS) + 1))
        i = 0
        while i < len(texts):
            n, size = i, 0
            while n < len(texts) and (n == i or size < GATHER):
                size += len(texts[n])
                n += 1
            bigrams, at = _byte_bigrams_of(texts[i:n])
            score = np.add.reduceat(self.chain[bigrams], at, axis=0)
            out[i:n] = score[:, self.known].max(axis=1, keepdims=True) - score
            i = n
        out[:, ~self.known] = np.inf
        return out


def _margin(chain: tuple[str, str], text: str, odd: bool) -> float:
    """Gain that an inversion must bring. Reading as UTF-8 seldom succeeds by chance; of other
    chains less is asked where the text mixes scripts within a word or holds a character that
    undamaged texts hardly know, and more where a single character speaks."""
    if chain[1] == "utf-8":
        return 4.0
    if odd:
        return 5.0
    return 9.0 if sum(not c.isascii() for c in text) > 1 else 12.0


_WRONG = tuple(dict.fromkeys(c[0] for c in CHAINS if not _multibyte(c[0])))
_CHARSET = {w: frozenset(_table(w)[0]) for w in _WRONG}
_TO_UTF8 = np.array([c[1] == "utf-8" for c in CHAINS])
_FROM_MANY = [j for j, c in enumerate(CHAINS) if _multibyte(c[0])]
_REGROUPS = np.array([_multibyte(c[0]) or _multibyte(c[1]) for c in CHAINS])


def _inversions_of(models: Models, words: list[str]) -> list[tuple[bool, dict[tuple[str, str], tuple[float, str]]]]:
    """For every word, whether it is odd as it stands, and what every chain that can have made it
    gives back, with the gain each brings less ``PRIOR`` of what the classifier holds against the
    chain (reading as UTF-8 seldom succeeds by chance and loses nothing); sane results only.

    A chain is not inverted where its gain could not even outweigh a word that speaks against it:
    only pairs with a character beyond ASCII can gain, and none more than their own log-probability.
    """
    here, beyond, odd = models.usual_of(words)
    read: list[tuple[set[str], set[str], dict[int, str]]] = []
    for word in words:
        beyond_ascii = {c for c in word if c > "\x7f"}
        shows = {w for w in _WRONG if beyond_ascii <= _CHARSET[w]}  # encodings the whole word can have been read in
        holds = {w for w in _WRONG if _seen_utf8(w).search(word)} if _BESIDE.search(word) else set()
        read.append((shows, holds, {j: r for j in _FROM_MANY if (r := restore(word, CHAINS[j])) is not None}))
    # most words of East Asia end here: no chain can have made them, so none needs to be likely
    asked = [i for i, x in enumerate(read) if any(x)]
    behind = np.full((len(words), len(CHAINS)), np.inf)
    if asked:
        behind[asked] = models.behind([words[i] for i in asked])[:, :-1]
    most = -np.where(_REGROUPS, here[:, None], beyond[:, None]) - np.where(_TO_UTF8, 0.0, PRIOR * behind)
    tried = (most >= 0.0) & np.isfinite(behind)
    made: list[list[tuple[int, str]]] = [[] for _ in words]
    texts: dict[str, int] = {}  # many chains give the same back
    for i in asked:
        word, (shows, holds, many) = words[i], read[i]
        for j in np.flatnonzero(tried[i]).tolist():
            w, r = CHAINS[j][0], many.get(j)
            if w in (holds & shows if _TO_UTF8[j] else shows):
                r = restore(word, CHAINS[j])
            if r is None and _TO_UTF8[j] and w in holds:
                r = restore_parts(word, w)
            if r is not None:
                made[i].append((j, r))
                texts.setdefault(r, len(texts))
    usual, strange = (models.usual_of(list(texts))[i] for i in (0, 2)) if texts else (np.empty(0), np.empty(0, bool))
    out = []
    for i, (word, found) in enumerate(zip(words, made)):
        lost, mixed = _LOST.search(word), bool(_MIXED.search(word))
        options, sane = {}, {}
        for j, r in found:
            k = texts[r]
            if k not in sane:
                sane[k] = not (_LOST.search(r) and not lost or strange[k] and models.strange(r, word) or not mixed and _MIXED.search(r))
            if sane[k]:
                options[CHAINS[j]] = (float(usual[k] - here[i]) - (0.0 if _TO_UTF8[j] else PRIOR * float(behind[i, j])), r)
        out.append((mixed or bool(odd[i]), options))
    return out


def _inversions(models: Models, text: str) -> dict[tuple[str, str], tuple[float, str]]:
    return _inversions_of(models, [text])[0][1]


def _name(chain: tuple[str, str]) -> str:
    return f"{chain[1]}>{chain[0]}"


_NUMBER = {_name(c): j for j, c in enumerate(CHAINS)}


class _Word:
    """What is known of a word: what repairing it alone gives, and its inversions."""

    __slots__ = ("fixed", "chain", "gain", "options", "strange", "top")

    def __init__(self, word: str, strange: bool, options: dict[tuple[str, str], tuple[float, str]]):
        self.fixed, self.chain, self.gain = word, "", 0.0
        self.strange, self.options = strange, options
        self.top = max([-_AGAINST, *(g for g, _ in options.values())])  # the most it can say for any chain


def _judge_words(models: Models, words: list[str]) -> dict[str, _Word]:
    """All words judged together; what an inversion gives back is judged again in the next round, as
    text may have gone through several chains."""
    seen = dict(zip(words, _inversions_of(models, words))) if words else {}
    out = {w: _Word(w, *seen[w]) for w in words}
    steps: dict[str, list[str]] = {w: [] for w, x in out.items() if x.top >= 4.0}
    for _ in range(4):
        new = sorted({out[w].fixed for w in steps} - seen.keys())
        seen.update(zip(new, _inversions_of(models, new)) if new else ())
        for w in list(steps):
            x = out[w]
            odd, options = seen[x.fixed]
            good = [(g, c, r) for c, (g, r) in options.items() if g >= 4.0 and g >= _margin(c, x.fixed, odd)]
            # what reads as UTF-8 is not taken for a text of East Asia
            good = [y for y in good if y[1][1] not in _EAST_ASIA] or good if any(y[1][1] == "utf-8" for y in good) else good
            if good:
                gain, chain, x.fixed = max(good, key=lambda y: y[0])
                x.gain = x.gain or gain
                steps[w].append(_name(chain))
            if not good or x.fixed.isascii():
                x.chain = ",".join(reversed(steps.pop(w)))
    for w, done in steps.items():
        out[w].chain = ",".join(reversed(done))
    return out


class Repairer:
    """Repairs texts word by word, and by whole sentences where single words say too little.

    The gain of a sentence is the sum of its words' gains, so a sentence costs look-ups of words
    that are mostly known already.
    """

    def __init__(self, models: Models):
        self.models = models
        self.words: dict[str, _Word] = {}
        self.sentences: dict[str, tuple[str, list[str], bool]] = {}

    def _word(self, w: str) -> _Word:
        hit = self.words.get(w)
        if hit is None:
            hit = self.words[w] = _judge_words(self.models, [w])[w]
        return hit

    def learn(self, texts: list[str]) -> None:
        """Judge all new words of the texts together."""
        new = {w for t in texts for w in _SPACE.split(" ".join(_SENTENCE.split(t))) if not w.isascii() and w not in self.words}
        if len(self.words) + len(new) > WORD_CACHE:
            self.words.clear()
        order = sorted(new)
        for i in range(0, len(order), 2_000):
            self.words.update(_judge_words(self.models, order[i : i + 2_000]))

    def repair(self, text: str, rounds: int = 3) -> tuple[str, list[str]]:
        """The text with every piece restored that can be, and the chains that had made them.

        Words and sentences say where damage is; which chain made it the classifier says, first for
        the whole text and then for every damaged sentence. Where its chain does not give the piece back
        strictly, what words and sentences found alone stays.
        """
        chains: dict[str, int] = {}
        pieces: list[tuple[str, str, list[str]]] = []
        if len(self.sentences) > WORD_CACHE:
            self.sentences.clear()
        doubt = False
        for sentence in _KEEP_SENTENCE.split(text):
            found: list[str] = []
            fixed = sentence
            if not sentence.isascii():
                hit = self.sentences.get(sentence)
                if hit is None:
                    hit = self.sentences[sentence] = self._sentence(sentence)
                fixed, found, suspect = hit
                doubt |= suspect
            pieces.append((sentence, fixed, found))
        damaged = any(found for *_, found in pieces)
        named = [c for *_, found in pieces for c in found]
        whole = self._by_classifier(text, "".join(p[1] for p in pieces), named) if damaged or doubt else None
        if whole:
            fixed, name = whole
            more = self.repair(fixed, rounds - 1) if rounds > 1 and not fixed.isascii() else (fixed, [])
            return more[0], [name, *more[1]]
        done = []
        for sentence, fixed, found in pieces:
            again = self._by_classifier(sentence, fixed, found) if found else None
            if again:
                more = self.repair(again[0], rounds - 1) if rounds > 1 and not again[0].isascii() else (again[0], [])
                fixed, found = more[0], [again[1], *more[1]]
            for c in found:
                chains[c] = chains.get(c, 0) + 1
            done.append(fixed)
        return "".join(done), sorted(chains, key=lambda c: (-chains[c], c))

    def _by_classifier(self, text: str, fixed: str, named: list[str]) -> tuple[str, str] | None:
        """What the likeliest chain gives back and its name: only if the classifier takes the text for
        damaged, by far where nothing else says so (``named`` is empty), the chain gives it back strictly and
        the result is sane and more usual. Of chains nearly as likely, and of what the words found alone
        (``fixed``), the one counts whose result is the most usual for its likelihood."""
        behind = self.models.behind([text])[0]
        odds, gain = (ODDS, 2.0) if named else (ODDS_ALONE, 9.0)
        if behind[-1] < odds:
            return None
        made = []
        for j in np.flatnonzero((behind[:-1] <= NEAR) & (behind[-1] - behind[:-1] >= odds)):
            r = restore(text, CHAINS[j])
            if r is not None and not (_LOST.search(r) and not _LOST.search(text) or _MIXED.search(r) and not _MIXED.search(text)):
                made.append((self.models.usual(r), -float(behind[j]), r, _name(CHAINS[j])))
        if not made:
            return None
        usual, against, r, name = max(made, key=lambda x: (x[0] + x[1], x[3]))
        if named:
            # the step that was undone first made the damage that the classifier sees
            held = max(float(behind[_NUMBER[c.rsplit(",", 1)[-1]]]) for c in named)
            if self.models.usual(fixed) - held > usual + against:
                return None
        return (r, name) if usual - self.models.usual(text) >= gain else None

    def _sentence(self, s: str) -> tuple[str, list[str], bool]:
        """The sentence repaired by its words, the chains, and whether a word would gain by some chain."""
        parts = _KEEP_SPACE.split(s)
        words = {i: self._word(w) for i, w in enumerate(parts) if not w.isascii()}
        if sum(w.top for w in words.values()) < 4.0 and not any(w.chain for w in words.values()):
            return s, [], any(w.top > DOUBT for w in words.values())  # no chain can reach the least margin
        total, chain = self._shared_chain(list(words.values()))
        found = []
        for i, w in words.items():
            gain, text = w.options.get(chain) or self._by(chain, parts[i])
            # what most of the sentence went through, and perhaps another chain before it
            if text and gain > (-4.0 if total >= 15 else 0.0) and (not w.chain or gain > w.gain - 6.0):
                again = None if text.isascii() else self._word(text)
                parts[i] = again.fixed if again and again.chain else text
                found.append(f"{again.chain},{_name(chain)}" if again and again.chain else _name(chain))
            elif w.chain:
                parts[i] = w.fixed
                found.append(w.chain)
        return "".join(parts), found, True

    def _by(self, chain: tuple[str, str] | None, word: str) -> tuple[float, str]:
        r = restore(word, chain) if chain else None
        if r is None or _LOST.search(r) or _MIXED.search(r):
            return 0.0, ""
        return self.models.usual(r) - self.models.usual(word), r

    def _shared_chain(self, words: list[_Word]) -> tuple[float, tuple[str, str] | None]:
        """The chain that the words together speak for; a word it cannot have made speaks against."""
        gain: dict[tuple[str, str], float] = {}
        for w in words:
            for c, (g, _) in w.options.items():
                gain[c] = gain.get(c, 0.0) + g + _AGAINST
        usual = 5.0 if any(w.strange for w in words) else 9.0 if len(words) > 1 else 12.0
        best = (0.0, None)
        unicode = any(c[1] == "utf-8" and g - _AGAINST * len(words) >= 4.0 for c, g in gain.items())
        for c, g in gain.items():
            g -= _AGAINST * len(words)
            if unicode and c[1] in _EAST_ASIA:
                continue
            if g >= (4.0 if c[1] == "utf-8" else usual) and g > best[0]:
                best = (g, c)
        return best


def fit_models(documents: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> Models:
    """Both models. The counts of neighbours come from all undamaged texts of the table; the chain
    classifier from about ``train_documents`` rows spread by a hash of the id."""
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    share = max(1, texts.count() // max(1, train_documents))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    schema = "kind string, bucket int, n long"
    clean = texts.select("text").mapInPandas(_count_clean, schema)
    garbled = sample.select("text").repartition(max(2, texts.sparkSession.sparkContext.defaultParallelism)).mapInPandas(_count_garbled, schema)
    sums = clean.unionByName(garbled).groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    return Models(sums.toPandas())  # at most PAIR + CHAR + chains x BIGRAM buckets


def judge(documents: DataFrame, models: Models) -> DataFrame:
    """(doc_id, restored, chains, lost): rows of damaged texts only. restored is null where a part
    could not be had back; lost says that some of it is gone for good."""
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(shared.value)
        for b in batches:
            rows = []
            repairer.learn(list(b["text"]))
            for i, t in zip(b["doc_id"], b["text"]):
                fixed, chains = repairer.repair(t)
                lost = _LOST.search(fixed) is not None
                if chains or lost:
                    rows.append((i, None if lost else fixed, ",".join(chains), lost))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "chains", "lost"])

    beyond = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x00-\\x7f]")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # judging a text costs far more than moving it, so the texts are dealt out evenly first; those
    # with the same first character beyond ASCII side by side, for a task judges each word once
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = beyond.withColumn("_first", F.regexp_extract("text", "[^\\x00-\\x7f]", 0)).repartitionByRange(tasks, "_first", F.xxhash64("doc_id"))
    return dealt.select("doc_id", "text").mapInPandas(run, "doc_id long, restored string, chains string, lost boolean")


def repair_documents(documents: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``judge`` with models fitted on the table itself."""
    return judge(documents, fit_models(documents, train_documents))


def garbled_documents(documents: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id) of every document with damaged text."""
    return repair_documents(documents, train_documents).select("doc_id").distinct()
