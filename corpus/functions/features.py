"""Features of a text from its tokens, by rules: one Arrow pass over the rows, no shuffle.

Words are runs of letters and digits, inner apostrophes and hyphens included, in lower case; a sentence is a stretch
without . ! ? or line break that holds a word. Parts of speech and heads come from word lists: the root of a sentence is
its first auxiliary, else its first word; a function word depends on the next content word, a content word on the root.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
SENTENCE = re.compile(r"[^.!?\n]+")
VOWELS = re.compile(r"[aeiouy]+")
THRESHOLD, TOP = 0.72, 20

# Markers of discourse of one word, endings of nominalizations, pronouns that refer.
DISCOURSE = "and also moreover furthermore besides additionally but however nevertheless nonetheless yet although though because since therefore thus hence consequently so when while then after before meanwhile subsequently first firstly second secondly finally lastly next specifically".split()
NOMINAL = ("tion", "ment", "ness", "ity", "ance", "ence", "ism", "ship", "dom", "sis", "ure")
REFERRING = "he she it they them his her its their this that these those".split()
# Our own lists for the rules above.
PERSONAL = "i me my mine myself we us our ours ourselves you your yours yourself yourselves".split()
AUXILIARY = "is are was were am be been has have had do does did can could will would shall should may might must".split()
BE = "is are was were am be been".split()
FUNCTION = "a an the of in on at for to from by with and or but that this these those my your his her its our their not no very".split()
IRREGULAR = "made done given taken seen known shown written found held kept left lost paid said sold sent told built brought bought caught taught".split()


def _factors(words: list[str]) -> float:
    factors, n, seen = 0.0, 0, set()
    for w in words:
        n += 1
        seen.add(w)
        if len(seen) / n <= THRESHOLD:
            factors, n = factors + 1, 0
            seen.clear()
    return factors + ((1 - len(seen) / n) / (1 - THRESHOLD) if n else 0.0)


def mtld(words: list[str]) -> float:
    """Words per factor, the mean of both directions; 0 where either has none."""
    there, back = _factors(words), _factors(words[::-1])
    return 0.0 if not words or not there or not back else len(words) / ((there + back) / 2)


def syllables(word: str) -> int:
    """Groups of vowels, a silent e at the end left out, one at least."""
    n = len(VOWELS.findall(word))
    return max(1, n - (word.endswith("e") and not word.endswith("le")))


def dependencies(words: list[str]) -> list[int]:
    """The place of each word's head; the root has its own place."""
    root = next((i for i, w in enumerate(words) if w in _AUX), 0)
    heads, content = [root] * len(words), root
    for i in range(len(words) - 1, -1, -1):
        if i == root:
            content = i
        elif words[i] in _FUNCTION:
            heads[i] = content if content > i else root
        else:
            content = i
    return heads


def depths(heads: list[int]) -> list[int]:
    """Steps from each word to the root, the root being 1."""
    out = []
    for i in range(len(heads)):
        k = 1
        while heads[i] != i:
            i, k = heads[i], k + 1
        out.append(k)
    return out


_AUX, _FUNCTION, _DISCOURSE, _REFERRING, _PERSONAL, _BE, _IRREGULAR = map(frozenset, (AUXILIARY, FUNCTION, DISCOURSE, REFERRING, PERSONAL, BE, IRREGULAR))


def _cohesion(sentences: list[list[str]]) -> float:
    sets = [{w for w in s if w.isalpha() and w not in _FUNCTION and w not in _AUX} for s in sentences]
    shared = sum(len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:]) if a and b)
    return shared / (len(sentences) - 1) if len(sentences) > 1 else 0.0


def _distance(words: list[str]) -> float:
    arcs = [abs(i - h) for i, h in enumerate(dependencies(words)) if i != h]
    return sum(arcs) / len(arcs) if arcs else 0.0


def _passives(words: list[str]) -> int:
    return sum(a in _BE and (b.endswith("ed") or b in _IRREGULAR) for a, b in zip(words, words[1:]))


def _of(words: list[str], some: frozenset[str]) -> float:
    return 100.0 * sum(w in some for w in words) / len(words)


#: Each feature from the sentences s, as lists of words, and all words w.
RULES = {
    "word_count": lambda s, w: float(len(w)),
    "sentence_length": lambda s, w: len(w) / len(s),
    "mtld": lambda s, w: mtld(w),
    "top20_word_share": lambda s, w: 100.0 * sum(c for _, c in Counter(w).most_common(TOP)) / len(w),
    "hapax_ratio": lambda s, w: 100.0 * sum(c == 1 for c in Counter(w).values()) / len(w),
    "lexical_cohesion": lambda s, w: _cohesion(s),
    "referential_density": lambda s, w: _of(w, _REFERRING),
    "mdd": lambda s, w: sum(map(_distance, s)) / len(s),
    "tree_depth": lambda s, w: sum(max(depths(dependencies(x))) for x in s) / len(s),
    "nominalization_rate": lambda s, w: 100.0 * sum(x.endswith(NOMINAL) for x in w) / len(w),
    "passive_ratio": lambda s, w: sum(map(_passives, s)) / len(s),
    "discourse_density": lambda s, w: _of(w, _DISCOURSE),
    "pronoun_ratio": lambda s, w: _of(w, _PERSONAL),
    "fkgl": lambda s, w: 0.39 * len(w) / len(s) + 11.8 * sum(map(syllables, w)) / len(w) - 15.59,
}
FEATURES = list(RULES)


def analysed(text: str | None, names: list[str] | None = None) -> list[float] | None:
    """The named features of a text, all without names; None for null, for under ten characters, and where there is no word."""
    if text is None or len(text) < 10:
        return None
    sentences = [w for s in SENTENCE.findall(text.lower()) if (w := WORD.findall(s))]
    words = [w for s in sentences for w in s]
    return [RULES[n](sentences, words) for n in names or FEATURES] if words else None


def with_features(df: DataFrame, key: str, text: str, names: list[str] | None = None) -> DataFrame:
    """(key, names) of the rows that have features; only the named ones are computed."""
    names = names or FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [analysed(t, names) for t in b.column(1).to_pylist()]
            held = pa.array([x is not None for x in found], pa.bool_())
            cols = list(zip(*(x for x in found if x))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(held), *(pa.array(c, pa.float64()) for c in cols)], [key, *names])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in names))
