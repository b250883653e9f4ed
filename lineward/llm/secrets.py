"""Secrets in texts: fixed forms by pattern, others by how random their characters follow each other.

Two character Markov models, one of random strings and one of ordinary words and identifiers, are counted,
the first on made keys and the values of the fixed forms, the second on the words of all documents. A run of
key-like characters is a finding if it is likelier under the first.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import map_texts, texts_of

# The forms that are always searched.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS, HEX = 6, re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

#: Runs that the models judge, their least length included.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A run is random if its log-likelihood ratio is this much for each character, on average; a shorter one than
#: WHOLE characters needs the evidence of so many.
PER_CHARACTER, WHOLE = 0.7, 20
#: Made strings of each kind: so many for up to so many documents, and more in proportion.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 4000
_LEAN = 5.0
_SYMBOLS = 96  # printable ASCII, and one for all else


def _codes(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 32) & (raw < 127), raw - 31, 0)


def _counted(strings: list[str]) -> np.ndarray:
    """How often each symbol follows each in the strings."""
    raw = np.frombuffer("\0".join(strings).encode("ascii", "replace"), np.uint8).astype(np.int64)
    c, inside = _codes(raw), raw != 0
    steps = inside[:-1] & inside[1:]
    return np.bincount((c[:-1] * _SYMBOLS + c[1:])[steps], minlength=_SYMBOLS * _SYMBOLS).reshape(_SYMBOLS, _SYMBOLS)


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Probability of each symbol after each; rare pairs lean on how frequent the symbol is at all."""
    alone = (counts.sum(0) + 1) / (counts.sum() + _SYMBOLS)
    return (counts + _LEAN * alone) / (counts.sum(1, keepdims=True) + _LEAN)


@dataclass
class RandomnessModel:
    """Log-likelihood ratio of each transition: random over ordinary."""

    ratio: np.ndarray

    def scores(self, strings: list[str]) -> np.ndarray:
        """Mean ratio for each string of two ASCII characters or more."""
        sizes = np.array([len(s) for s in strings])
        c = _codes(np.frombuffer("".join(strings).encode("ascii"), np.uint8).astype(np.int64))
        steps = np.append(self.ratio[c[:-1], c[1:]], 0.0)
        ends = np.cumsum(sizes)
        steps[ends - 1] = 0.0  # no transition from one string to the next
        return np.add.reduceat(steps, ends - sizes) / (sizes - 1)


    def is_random(self, strings: list[str]) -> np.ndarray:
        """Whether each string's evidence is enough: PER_CHARACTER on average, and as much in all as WHOLE characters have."""
        sizes = np.array([len(s) for s in strings])
        return self.scores(strings) * sizes >= PER_CHARACTER * np.maximum(sizes, WHOLE)


def _fit_counts(random_counts: np.ndarray, ordinary: np.ndarray) -> RandomnessModel:
    return RandomnessModel(np.log(_probabilities(random_counts)) - np.log(_probabilities(ordinary)))


def fit(random_strings: list[str], ordinary: list[str]) -> RandomnessModel:
    return _fit_counts(_counted(random_strings), _counted(ordinary))


def _made_keys() -> list[str]:
    rng = random.Random(17)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    sets = [digits + "abcdef", lower + digits, lower + lower.upper() + digits, lower.upper() + digits,
            lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "_-"]
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(16, 64))) for i in range(SAMPLE_RANDOM)]


def _key_values_and_words(text: str) -> tuple[list[str], list[str]]:
    keys: list[str] = []
    for form, group in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0)):
        keys += [m.group(group) for m in form.finditer(text) if len(m.group(group)) >= 16]
        text = form.sub(" ", text)
    # Long runs with letters and digits are what is looked for, whatever they stand in.
    return keys, [w for w in re.findall(r"[A-Za-z0-9]{2,}", text) if len(w) < 16 or w.isalpha()]


def _names(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Names built of words in all the ways of joining them, and words that repeat."""
    first, out = rng.randrange(20), []
    for i in range(first, first + n):
        some = rng.choices(words, k=rng.randint(2, 5))
        out.append("".join(w.capitalize() for w in some) if i % 5 == 0 else "_-/="[i % 4].join(some))
    return out + [w * 4 for w in rng.choices(words, k=n)]


#: Rulers and counters are ordinary as well.
_RULERS = [c * 24 for c in "-=_+/xX0"]


def labelled_strings(texts: list[str]) -> tuple[list[str], list[str]]:
    """Random strings and ordinary ones: values of the fixed forms and made keys, words and names built of them."""
    found = [_key_values_and_words(text) for text in texts]
    words = [w for _, own in found for w in own] or ["the", "and", "of"]
    return (_made_keys() + [k for own, _ in found for k in own],
            words + _names(words, SAMPLE_RANDOM, random.Random(17)) + _RULERS)


def _all_counts(docs: DataFrame, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions in the values of the fixed forms, and in words and names of all documents: counted by tasks, summed by Spark."""

    def run(batches):
        total = np.zeros((2, _SYMBOLS, _SYMBOLS), np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                keys, words = _key_values_and_words(text)
                if words:  # by a hash of the text, so that no other document counts
                    words += _names(words, names, random.Random(zlib.crc32(text.encode())))
                for side, strings in enumerate((keys, words)):
                    if strings:
                        total[side] += _counted(strings)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": total.reshape(-1)[cells]})

    rows = texts_of(docs).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 2 x 96 x 96 at most
    out = np.zeros(2 * _SYMBOLS * _SYMBOLS)
    for r in rows:
        out[r["cell"]] = r["n"]
    return tuple(out.reshape(2, _SYMBOLS, _SYMBOLS))


def train(docs: DataFrame) -> RandomnessModel:
    """Models from all documents and made keys.

    Made strings keep their share whatever the number of documents: names are built in every document, of
    its words, and the counts of made keys and rulers are multiplied.
    """
    n = max(1, docs.count())
    values, ordinary = _all_counts(docs, -(-SAMPLE_RANDOM // min(n, SAMPLE_DOCS)))
    if not ordinary.any():
        ordinary = _counted(labelled_strings([])[1])
    times = max(1.0, n / SAMPLE_DOCS)
    return _fit_counts(values + times * _counted(_made_keys()), ordinary + times * _counted(_RULERS))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (exclusive) of the fixed forms, kind by kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _join(spans: list[tuple[str, int, int]]) -> str:
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _uncovered(runs: Iterable[re.Match], spans: list[tuple[str, int, int]]) -> list[re.Match]:
    """The runs, in order, that no single span covers whole; one walk along both."""
    by_start, out = sorted((a, b) for _, a, b in spans), []
    at, reach = 0, -1  # the furthest end of the spans that start at or before the run
    for m in runs:
        while at < len(by_start) and by_start[at][0] <= m.start():
            reach = max(reach, by_start[at][1])
            at += 1
        if reach < m.end():
            out.append(m)
    return out


def scan(docs: DataFrame, model: RandomnessModel | None = None) -> DataFrame:
    """Secrets of every whole text of ``docs(doc_id, text)``; the models are trained on ``docs`` if not given.

    doc_id, n_assign, n_access, n_hex, base_sha256 (of the fixed forms' spans) and spans: kind:start:end in
    code points, by start, then kind. ``random`` spans come from the models; a run that a fixed form
    covers whole isn't listed again. Null and empty texts have no spans; repeated rows come back as often, null ids as
    they are; no rows give none. A text of any length takes time in proportion.
    """
    model = model or train(docs)

    def run(keys, texts):
        base, runs = [], []
        for i, text in enumerate(texts):
            own = base_spans(text)
            base.append(own)
            runs += [(i, m.start(), m.group()) for m in _uncovered(CANDIDATE.finditer(text), own)]
        extra: list[list] = [[] for _ in texts]
        if runs:
            strings = [r[2] for r in runs]
            for (i, at, s), random_ in zip(runs, model.is_random(strings).tolist()):
                if random_:
                    extra[i].append(("random", at, at + len(s)))
        n = [[sum(k == kind for k, _, _ in own) for own in base] for kind in KINDS[:3]]
        return {"doc_id": keys, "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                "base_sha256": [hashlib.sha256(_join(own).encode()).hexdigest() for own in base],
                "spans": [_join(own + more) for own, more in zip(base, extra)]}

    return map_texts(texts_of(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, "
                                          "base_sha256 string, spans string")
