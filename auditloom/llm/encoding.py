"""Text read in a wrong encoding: found with a hidden Markov model and turned back.

The model has a clean state and one state for each pair of a true and a wrong encoding (also applied
twice and three times), and one for characters that are lost. Character pairs counted over all texts give
the clean state's emissions; passing them through a pair's forward transform gives that pair's. Viterbi
labels the characters of each sentence, and a labelled span gets its state's inverse transform, widened
to the sentence it stands in: only where one state explains every special character of a sentence was the
sentence misread, so a clean text that quotes a few garbled letters stays as it is.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.runtime import cut_lineage, join_per_key, spread, stored

# Pairs of true and wrong encoding, and how often the text was misread.
PAIRS: list[tuple[str, str, int]] = [
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "cp1252", 3),
    ("utf-8", "mac_roman", 1), ("utf-8", "cp850", 1), ("utf-8", "cp437", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1),
    ("utf-8", "koi8-r", 1), ("utf-8", "cp866", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "cp1254", 1),
    ("cp1252", "mac_roman", 1), ("cp1252", "cp850", 1), ("cp1252", "cp437", 1), ("cp1252", "cp1250", 1), ("cp1252", "cp1251", 1),
    ("cp1250", "cp1252", 1), ("cp1250", "cp852", 1), ("iso8859-2", "cp1252", 1), ("iso8859-2", "cp1250", 1),
    ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("koi8-r", "cp866", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp1252", 1),
    ("cp1251", "cp866", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1), ("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1),
    ("iso8859-5", "cp1251", 1), ("cp1251", "mac_roman", 1), ("cp1250", "mac_roman", 1),
]
LOST = "�"
#: States: 0 clean, 1.. pairs, last lost. Character pairs held by every task besides those of the pages (the most frequent); others are joined.
STATES, MAX_BIGRAMS = len(PAIRS) + 2, 200_000
_FLOOR = math.log(1e-8)
_ASCII = 1 << 7
_LOW, _PAIR = (1 << 21) - 1, 1 << 42
#: Distinct characters and pairs that a task counts before it hands them on.
_COUNTED = 1 << 19
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\xa0]+|[\r\n]+")
_SHORT_QUOTE = re.compile(r"\"[^\"\n]{1,12}\"|“[^”\n]{1,12}”|‘[^’\n]{1,12}’|«[^»\n]{1,12}»|„[^“”\n]{1,12}[“”]|'[^'\n]{1,12}'")


def _page(codec: str) -> tuple[list[str], dict[str, int]]:
    """Characters of the 256 bytes (undefined ones as control characters) and the way back."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return chars, back


_PAGES = {c: _page(c) for c in {w for _, w, _ in PAIRS} | {t for t, _, _ in PAIRS if t != "utf-8"}}
#: Characters of any page, 522: misread text is written in them, so only the clean state can know a pair beyond them.
_PAGE_CODES = np.array(sorted({ord(c) for chars, _ in _PAGES.values() for c in chars} | set(range(_ASCII))), np.int64)


def misread(text: str, pair: tuple[str, str, int]) -> str | None:
    """``text`` as it looks when read in the pair's wrong encoding; None if the true one can't write it."""
    true, wrong, times = pair
    chars = _PAGES[wrong][0]
    for _ in range(times):
        try:
            raw = text.encode("utf-8") if true == "utf-8" else bytes(_PAGES[true][1][c] for c in text)
        except (KeyError, UnicodeEncodeError):
            return None
        text = "".join(chars[b] for b in raw)
    return text


def reread(text: str, pair: tuple[str, str, int]) -> str | None:
    """The inverse of ``misread``; None where ``text`` can't have come about that way.

    A lost character may stand for a byte that the wrong encoding lacks.
    """
    true, wrong, times = pair
    back = _PAGES[wrong][1]
    for _ in range(times):
        raw, lost = bytearray(), False
        for c in text:
            b = back.get(c)
            if b is None:
                if c != LOST:
                    return None
                lost, b = True, 0x81
            raw.append(b)
        if true == "utf-8":
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            chars = _PAGES[true][0]
            text = "".join(LOST if c == LOST else chars[b] for c, b in zip(text, raw, strict=True))
        if lost and true == "utf-8" and LOST in text:
            return None
    return text


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def character_counts(texts: DataFrame) -> tuple[dict[int, int], dict[int, int], DataFrame | None]:
    """Counts over all texts of single characters (code point) and of pairs with a character beyond ASCII.

    A pair is coded as (first << 21 | second) + (1 << 42). Returned are the counts that every task holds: all
    characters, all pairs of page characters and the ``MAX_BIGRAMS`` most frequent others; then the sums of the
    remaining pairs by last byte of the first and first byte of the second character in UTF-8 (coded as a pair
    with these bytes), which is all that the misread states take from them; and the remaining pairs themselves,
    a table ``(code, n)``, or None if there are none. Pairs with a lost character are left out, no state uses them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["code", "n"])

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for i in range(0, len(rows), 64):
                c = _codes("\n".join(x for x in rows[i : i + 64] if x))
                if not len(c):
                    continue
                a, b = c[:-1], c[1:]
                special = (a >= _ASCII) | (b >= _ASCII)
                pairs = (a[special] << 21 | b[special]) + _PAIR
                for keys in (c, pairs):
                    k, n = np.unique(keys, return_counts=True)
                    for x, y in zip(k.tolist(), n.tolist(), strict=True):
                        total[x] += y
                if len(total) > _COUNTED:
                    yield counted()
                    total.clear()
        yield counted()

    counts = cut_lineage(texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    a, b = F.shiftright("code", 21).bitwiseAND(_LOW), F.col("code").bitwiseAND(_LOW)
    single, lost = F.col("code") < _PAIR, (a == ord(LOST)) | (b == ord(LOST))
    pages = ", ".join(map(str, _PAGE_CODES.tolist()))
    inner = F.expr(f"(shiftright(code, 21) & {_LOW}) IN ({pages}) AND (code & {_LOW}) IN ({pages})")
    held = _as_dict(counts.where(single | inner))
    others = counts.where(~single & ~inner & ~lost)
    often = _as_dict(others.orderBy(F.desc("n"), "code").limit(MAX_BIGRAMS))
    held.update(often)
    if len(often) < MAX_BIGRAMS:
        return held, {}, None
    if often:
        code, n = max(often.items(), key=lambda x: (-x[1], x[0]))  # the last one held
        others = others.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("code") > code)))
    last = F.when(a < _ASCII, a).otherwise(a.bitwiseAND(0x3F).bitwiseOR(0x80))
    first = F.when(b < _ASCII, b).when(b < 0x800, F.shiftright(b, 6) + 0xC0).when(b < 0x10000, F.shiftright(b, 12) + 0xE0).otherwise(F.shiftright(b, 18) + 0xF0)
    sums = _as_dict(others.groupBy((F.shiftleft(last, 21).bitwiseOR(first) + _PAIR).alias("code")).agg(F.sum("n").alias("n")))
    return held, sums, others if sums else None


def _as_dict(counts: DataFrame) -> dict[int, int]:
    found = counts.toArrow()
    return dict(zip(found["code"].to_pylist(), found["n"].to_pylist(), strict=True))


def _unpaired(counts: dict[int, int]) -> dict[tuple[int, int], int]:
    return {((k - _PAIR) >> 21, k & _LOW): n for k, n in counts.items() if k >= _PAIR}


def _beginning(byte: int) -> int:
    """A character whose first byte in UTF-8 is ``byte``."""
    if byte < 0xE0:
        return byte if byte < _ASCII else (byte & 0x1F) << 6
    return max(0x800, (byte & 0x0F) << 12) if byte < 0xF0 else max(0x10000, (byte & 0x07) << 18)


def _clean(n: int, first: int) -> float:
    """Log-probability in the clean state of a pair counted ``n`` times, its first character ``first`` times."""
    return max(_FLOOR, math.log(n / max(first, n)))


def _sorted(values: dict[int, float], kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(list(values), np.int64)
    order = np.argsort(keys)
    return keys[order], np.array(list(values.values()), kind)[order]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` the sorted array ``known`` holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Model:
    """Emission log-probabilities of every known character pair in every state."""

    def __init__(self, counts: dict[int, int], sums: dict[int, int] | None = None):
        single = {k: n for k, n in counts.items() if k < _PAIR}
        pairs, beyond, pages = {}, {}, set(_PAGE_CODES.tolist())
        for (a, b), n in _unpaired(counts).items():
            (pairs if a in pages and b in pages else beyond)[(a, b)] = n
        # Of pairs beyond the pages, a misread state takes the last byte of the first and the first byte of the second character.
        classes = defaultdict(int, _unpaired(sums or {}))
        for (a, b), n in beyond.items():
            if not any(c == ord(LOST) or 0xD800 <= c < 0xE000 for c in (a, b)):
                classes[chr(a).encode()[-1], chr(b).encode()[0]] += n
        rest = [((a, _beginning(b)), n) for (a, b), n in classes.items()]  # U+0080 to U+00BF end in the byte of their own number
        self._forward: dict[tuple[int, int], str | None] = {}
        self._purge(single, pairs)
        rows: dict[tuple[int, int], np.ndarray] = {}

        def put(state: int, ab: tuple[int, int], p: float) -> None:
            if ab not in rows:
                rows[ab] = np.full(STATES, _FLOOR, np.float32)
            rows[ab][state] = max(_FLOOR, p)

        for s, pair in enumerate(PAIRS, 1):
            seen: dict[tuple[int, int], float] = defaultdict(float)
            context: dict[int, float] = defaultdict(float)
            for a, n in single.items():
                f = self._fwd(s, a)
                if f:
                    for c in f:
                        context[ord(c)] += n
            for (a, b), n in [*pairs.items(), *(rest if pair[0] == "utf-8" else ())]:
                fa, fb = self._fwd(s, a), self._fwd(s, b)
                if fa and fb and (fa != chr(a) or fb != chr(b) or a < _ASCII or b < _ASCII):
                    seen[(ord(fa[-1]), ord(fb[0]))] += n
            for b, n in single.items():
                f = self._fwd(s, b) or ""
                for x, y in zip(f, f[1:]):
                    seen[(ord(x), ord(y))] += n
            for ab, n in seen.items():
                if (ab[0] >= _ASCII or ab[1] >= _ASCII) and n > 0:
                    put(s, ab, math.log(min(1.0, n / max(context.get(ab[0], 0.0), n))))
        others: dict[int, float] = {}
        for (a, b), n in [*pairs.items(), *beyond.items()]:
            if a != ord(LOST) and b != ord(LOST):
                p = _clean(n, single.get(a, 0))
                if (a, b) in rows:
                    put(0, (a, b), p)
                else:
                    others[a << 21 | b] = p
        keys = np.array([a << 21 | b for a, b in rows], np.int64)
        order = np.argsort(keys)
        self.use(keys[order], np.array(list(rows.values()), np.float32).reshape(-1, STATES)[order], _sorted(others))
        del self._forward

    def use(self, keys: np.ndarray, table: np.ndarray, clean: tuple[np.ndarray, np.ndarray]) -> Model:
        """Take over tables made elsewhere: of the pairs that a misread state knows, and those that only the clean one does."""
        self.keys, self.table, self.clean = keys, table, clean
        known = np.concatenate([keys, clean[0]])
        order = np.argsort(known, kind="stable")
        self.values = [(known[order], np.concatenate([table[:, 0], clean[1]])[order])]
        self.gain = np.maximum(0, table[:, 1:].max(axis=1) - table[:, 0]) if len(keys) else np.zeros(0, np.float32)
        return self

    def knowing(self, others: dict[int, float]) -> Model:
        """This model with clean log-probabilities of further pairs."""
        more = Model.__new__(Model)
        more.keys, more.table, more.gain, more.values = self.keys, self.table, self.gain, [*self.values, _sorted(others)]
        return more

    def unknown(self, text: str) -> np.ndarray:
        """The pairs of ``text`` with a character beyond ASCII whose clean log-probability may stand outside this model."""
        codes = _codes(text)
        a, b = codes[:-1], codes[1:]
        outside = ~_among(codes, _PAGE_CODES)
        keep = (outside[:-1] | outside[1:]) & (a != ord(LOST)) & (b != ord(LOST))
        key = np.unique(a[keep] << 21 | b[keep])
        for known, _ in self.values:
            key = key[~_among(key, known)]
        return key

    def _fwd(self, s: int, code: int) -> str | None:
        k = (s, code)
        if k not in self._forward:
            self._forward[k] = chr(code) if code < _ASCII else (None if code == ord(LOST) or 0xD800 <= code < 0xE000 else misread(chr(code), PAIRS[s - 1]))
        return self._forward[k]

    def _purge(self, single: dict[int, int], pairs: dict[tuple[int, int], int]) -> None:
        """Take out of the clean counts what is far rarer than that of which it is the misreading."""
        bad: set[tuple[int, int]] = set()
        for s, (true, _, _) in enumerate(PAIRS, 1):
            if true == "utf-8":
                for c, n in single.items():
                    f = self._fwd(s, c) if c >= _ASCII else None
                    for x, y in zip(f or "", (f or "")[1:]):
                        if pairs.get((ord(x), ord(y)), 0) < 0.3 * n:
                            bad.add((ord(x), ord(y)))
            else:
                for (a, b), n in pairs.items():
                    fa, fb = self._fwd(s, a), self._fwd(s, b)
                    if fa and fb:
                        g = (ord(fa), ord(fb))
                        if g != (a, b) and pairs.get(g, 0) < 0.04 * n:
                            bad.add(g)
        for g in bad:
            if g in pairs:
                del pairs[g]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities (steps x states) of each pair of codes with a character beyond ASCII."""
        a, b = codes[:-1], codes[1:]
        special = (a >= _ASCII) | (b >= _ASCII)
        key = a[special] << 21 | b[special]
        out = np.full((len(key), STATES), _FLOOR, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.table[at[hit]]
            out[~hit, 0] = self.clean_emissions(key[~hit])
        lost = (key & _LOW == ord(LOST)) | (key >> 21 == ord(LOST))
        out[lost, STATES - 1] = math.log(0.02)
        return out

    def clean_emissions(self, key: np.ndarray) -> np.ndarray:
        """Log-probabilities of pairs in the clean state."""
        out = np.full(len(key), _FLOOR, np.float32)
        for known, value in self.values:
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                out[hit] = value[at[hit]]
        return out

    def suspects(self, text: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the stretches of ``text`` could leave the clean state at all, given what each step gains."""
        codes = _codes("\n" + text + "\n")
        a, b = codes[:-1], codes[1:]
        at = np.flatnonzero((a >= _ASCII) | (b >= _ASCII))
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64)
        key = a[at] << 21 | b[at]
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        gain = np.where(self.keys[where] == key, self.gain[where], 0.0)
        gain[(a[at] == ord(LOST)) | (b[at] == ord(LOST))] = 20.0
        total = np.concatenate([[0.0], np.cumsum(gain)])
        # Step i pairs characters i - 1 and i of the text.
        return np.flatnonzero(total[np.searchsorted(at, end + 1)] - total[np.searchsorted(at, begin)] > _ENTRY)

    def score(self, text: str) -> tuple[float, float]:
        """Sum of clean log-probabilities over the special pairs and the share of known ones."""
        codes = _codes("\n" + text + "\n")
        a, b = codes[:-1], codes[1:]
        special = (a >= _ASCII) | (b >= _ASCII)
        e = self.clean_emissions(a[special] << 21 | b[special])
        return float(e.sum()), float((e > _FLOOR).mean()) if len(e) else 1.0


_ENTRY = math.log(0.97) - math.log(0.03 / STATES) - 1.0
_STAY, _LEAVE, _ENTER = math.log(0.995), math.log(0.005), math.log(0.005 / STATES)
_START = np.full(STATES, math.log(0.03 / STATES), np.float32)
_START[0] = math.log(0.97)
_OTHER = _LEAVE + math.log(0.01)


def viterbi(e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most probable states of many sequences of steps, given one after the other with their ``sizes``.

    A state is stayed in, entered from the clean one, left to it, or changed to another; the last two have
    one price each, so the best way into a state is found without comparing all pairs of states.
    Sequences of like length are walked together.
    """
    path = np.zeros(len(e), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    own = np.arange(STATES)
    for c in range(0, len(order), 512):
        mine = order[c : c + 512]
        off, length = starts[mine], sizes[mine]
        best = _START + e[off]
        back: list[np.ndarray] = []
        for i in range(1, int(length[0])):
            n = int(np.searchsorted(-length, -i))  # those longer than i
            x = best[:n]
            top = x[:, 1:].argmax(axis=1) + 1
            most = x[np.arange(n), top]
            enter, other = x[:, 0] + _ENTER, most + _OTHER
            way, source = np.maximum(enter, other), np.where(enter >= other, 0, top)
            stay = x + _STAY
            leave = most + _LEAVE
            came = np.where(stay >= way[:, None], own, source[:, None])
            new = np.maximum(stay, way[:, None])
            new[:, 0] = np.maximum(stay[:, 0], leave)
            came[:, 0] = np.where(stay[:, 0] >= leave, 0, top)
            back.append(came.astype(np.int8))
            best[:n] = new + e[off[:n] + i]
        state = best.argmax(axis=1)
        path[off + length - 1] = state
        for i in range(int(length[0]) - 1, 0, -1):
            came = back[i - 1]
            n = len(came)
            state[:n] = came[np.arange(n), state[:n]]
            path[off[:n] + i - 1] = state[:n]
    return path


def _in_words(text: str) -> bool:
    """Whether most letters beyond ASCII stand beside a letter, as in words."""
    letters = [i for i, c in enumerate(text) if ord(c) >= _ASCII and c.isalpha()]
    beside = sum((i > 0 and text[i - 1].isalpha()) or text[i + 1 : i + 2].isalpha() for i in letters)
    return 2 * beside >= len(letters)


def mend_sentence(sentence: str, states: list[int], model: Model) -> tuple[str, str] | None:
    """``(state, text)`` of a sentence in which ``states`` were found, None if it is clean all the same.

    ``text`` is the restored sentence, or the sentence itself where characters are lost.
    """
    unquoted = _SHORT_QUOTE.sub(" ", sentence)
    special = {c for c in unquoted if ord(c) >= _ASCII}
    if not special:
        return None  # all of it stands in quotation marks
    before, _ = model.score(sentence)
    best: tuple[float, str, str] | None = None
    # A short sentence may carry too few signs to tell how often it was misread: all depths of the pair are tried.
    labels = {PAIRS[s - 1][:2] for s in states if s < STATES - 1}
    for pair in PAIRS:
        if pair[:2] not in labels:
            continue
        text = reread(sentence, pair)
        if text is None or text == sentence:
            continue
        after, known = model.score(text.replace(LOST, ""))
        # Fewer special characters remain after a repair, so compare the sums with a small price for each.
        if after > before + 1.0 and known >= 0.7 and _in_words(text) and (best is None or after > best[0]):
            best = (after, "{}>{}x{}".format(*pair), text)
    if best:
        return best[1], best[2]
    if LOST in special and all(c == LOST for c in sentence if ord(c) >= _ASCII and c not in "\xa0­"):
        return "lost", sentence
    return None


_LOSS = re.compile(r"(?<!\S)(?:[^\s/=&?]*(?:[^\W\d_A-Z]\?+[^\W\d_A-Z]|\?{2,}[^\W\d_A-Z])[^\s/=&]*|[(“„]?\?{3,}[.,;:)”]*)(?!\S)")


def mark_losses(text: str) -> str:
    """``text`` with ``?`` as a lost character in words that hold it in place of letters, if there are two such."""
    if "?" not in text or len(_LOSS.findall(text)) < 2:
        return text
    return _LOSS.sub(lambda m: m[0].replace("?", LOST), text)


def label(sentences: list[str], model: Model) -> list[list[int]]:
    """The states other than clean that the most probable path through each sentence visits."""
    text = "".join(f"\n{x}\n" for x in sentences)
    codes = _codes(text)
    at = np.flatnonzero((codes[:-1] >= _ASCII) | (codes[1:] >= _ASCII))
    sizes = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum([len(x) + 2 for x in sentences])])))
    e = model.emissions(codes)
    told = np.zeros(len(e) + 1, np.int64)
    np.cumsum(e[:, 1:].max(axis=1, initial=_FLOOR) > e[:, 0], out=told[1:])
    ends = np.cumsum(sizes)
    sizes = np.where(told[ends] > told[ends - sizes], sizes, 0)  # others stay clean
    keep = np.repeat(sizes > 0, np.diff(np.concatenate([[0], ends])))
    path = viterbi(e[keep], sizes)
    found, upto = [], 0
    for n in sizes.tolist():
        found.append([s for s in np.unique(path[upto : upto + n]).tolist() if s] if n else [])
        upto += n
    return found


def suspect_sentences(texts: list[str], model: Model) -> list[tuple[int, int, int]]:
    """``(text, begin, end)`` of the sentences that could leave the clean state."""
    whole, base, owner, begins, ends, bases = [], 0, [], [], [], []
    for k, text in enumerate(texts):
        bases.append(base)
        if text.isascii():
            continue
        at = 0
        for m in [*_SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                owner.append(k)
                begins.append(base + at)
                ends.append(base + end)
            at = m.end() if m else end
        whole.append(text)
        base += len(text) + 1
    joined = "\n".join(whole)
    some = model.suspects(joined, np.array(begins, np.int64), np.array(ends, np.int64)).tolist()
    return [(owner[i], begins[i] - bases[owner[i]], ends[i] - bases[owner[i]]) for i in some if not joined[begins[i] : ends[i]].isascii()]


def mend_all(texts: list[str], model: Model) -> list[tuple[list[str], str]]:
    """For each text the states of its misread sentences, and the text with those restored that can be."""
    texts = [mark_losses(x) for x in texts]
    some = suspect_sentences(texts, model)
    pieces = [texts[k][begin:end] for k, begin, end in some]
    mended: dict[int, list[tuple[int, int, str, str]]] = {}
    for (k, begin, end), piece, states in zip(some, pieces, label(pieces, model) if pieces else [], strict=True):
        found = mend_sentence(piece, states, model) if states else None
        if found:
            mended.setdefault(k, []).append((begin, end, *found))
    out = []
    for k, text in enumerate(texts):
        parts, at = [], 0
        for begin, end, _, new in mended.get(k, ()):
            parts += [text[at:begin], new]
            at = end
        out.append(([x[2] for x in mended.get(k, ())], "".join([*parts, text[at:]])))
    return out


def pairs_wanted(texts: list[str], model: Model) -> list[list[int]]:
    """For each text the pairs that ``mend_all`` may ask ``model`` for in vain, those of every possible repair included."""
    texts = [mark_losses(x) for x in texts]
    out: list[set[int]] = [set() for _ in texts]
    for k, begin, end in suspect_sentences(texts, model):
        piece = texts[k][begin:end]
        repairs = (reread(piece, pair) for pair in PAIRS)
        forms = {piece, *(x.replace(LOST, "") for x in repairs if x is not None)}
        out[k].update(model.unknown("".join(f"\n{x}\n" for x in forms)).tolist())
    return [sorted(x) for x in out]


def mend(text: str, model: Model) -> tuple[list[str], str]:
    """States of the misread sentences of ``text``, and the text with those restored that can be."""
    return mend_all([text], model)[0]


def misread_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, states, restored, lost)`` for each document with a misread text or sentence.

    ``states`` names the encoding pairs found (true>wrong x times, or ``lost``), ``restored`` is the text
    with the inverse transforms applied, ``lost`` counts sentences that can't be restored. Null and empty
    texts are clean; repeated rows give repeated results; texts of any length are read whole; an empty
    table gives no rows; further columns are ignored. Pairs of characters beyond those held by every task
    (``character_counts``) are joined to the texts under suspicion that need them, so all pairs count.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null and text <> ''")
    texts = spread(texts)
    counts, sums, rest = character_counts(texts.select("text"))
    model = Model(counts, sums)
    shared = documents.sparkSession.sparkContext.broadcast((model.keys, model.table, model.clean))
    result = f"id {texts.schema['id'].dataType.simpleString()}, states array<string>, restored string, lost int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model).use(*shared.value)
        for batch in batches:
            keep, found = [], []
            for start in range(0, batch.num_rows, 256):
                mended = mend_all(batch.column(1).slice(start, 256).to_pylist(), own)
                keep += [i for i, x in enumerate(mended, start) if x[0]]
                found += [x for x in mended if x[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *_columns(found)], ["id", "states", "restored", "lost"])

    if rest is None:
        return texts.mapInArrow(run, result)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As ``run``, but texts that need a pair which isn't held are passed on with the pairs they want."""
        own = Model.__new__(Model).use(*shared.value)
        for batch in batches:
            keep, found, texts, wanted = [], [], [], []
            for start in range(0, batch.num_rows, 256):
                some = batch.column(2).slice(start, 256).to_pylist()
                open_ = pairs_wanted(some, own)
                settled = iter(mend_all([x for x, codes in zip(some, open_, strict=True) if not codes], own))
                for i, (text, codes) in enumerate(zip(some, open_, strict=True), start):
                    mended = ([], "") if codes else next(settled)
                    if codes or mended[0]:
                        keep.append(i)
                        found.append(mended)
                        texts.append(text if codes else None)
                        wanted.append([x + _PAIR for x in codes] or None)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *_columns(found), pa.array(texts, pa.string()), pa.array(wanted, pa.list_(pa.int64()))],
                ["row", "id", "states", "restored", "lost", "text", "wanted"],
            )

    singles = _sorted({k: n for k, n in counts.items() if k < _PAIR}, np.int64)
    firsts = documents.sparkSession.sparkContext.broadcast(singles)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model).use(*shared.value)
        codes, times = firsts.value
        for batch in batches:
            keep, found = [], []
            for start in range(0, batch.num_rows, 256):
                pairs = dict(zip(*(x.to_pylist() for x in batch.column(2).slice(start, 256).flatten().flatten()), strict=True))
                first = times[np.searchsorted(codes, [(k - _PAIR) >> 21 for k in pairs])].tolist()
                more = own.knowing({k - _PAIR: _clean(n, m) for (k, n), m in zip(pairs.items(), first, strict=True)})
                mended = mend_all(batch.column(1).slice(start, 256).to_pylist(), more)
                keep += [i for i, x in enumerate(mended, start) if x[0]]
                found += [x for x in mended if x[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *_columns(found)], ["id", "states", "restored", "lost"])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    sifted = stored(numbered.mapInArrow(sift, f"row long, {result}, text string, wanted array<long>"))
    pending = sifted.where("wanted is not null")
    counted = join_per_key(pending.select("row", F.explode("wanted").alias("code")), rest, "code")
    counted = counted.groupBy("row").agg(F.collect_list(F.struct("code", "n")).alias("pairs"))
    finished = pending.select("row", "id", "text").join(counted, "row", "left").select("id", "text", "pairs").mapInArrow(finish, result)
    return sifted.where("wanted is null").select("id", "states", "restored", "lost").unionByName(finished)


def _columns(found: list[tuple[list[str], str]]) -> list[pa.Array]:
    """Columns ``states``, ``restored`` and ``lost`` of texts that ``mend_all`` mended."""
    states, restored = [sorted(set(x)) for x, _ in found], [x for _, x in found]
    return [pa.array(states, pa.list_(pa.string())), pa.array(restored, pa.string()), pa.array([x.count("lost") for x, _ in found], pa.int32())]
