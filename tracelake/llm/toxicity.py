"""Toxicity by a learned lexicon that tolerates misspelling.

From a bounded sample of labelled documents a lexicon is learned: words (written with an end mark) and beginnings of words
that toxic documents show and others don't. It is kept as a trie. A Levenshtein automaton of one edit runs over the trie from
every beginning of a run of letters or digits, and from every letter of a script without blanks, whatever stands before it.
It is built state by state as words ask for it. Each hit is scored in its window of words: a hit between
quotation marks counts less, and hits close to each other count more. A logistic regression turns the hits of a document
into a score.
"""

import math
import re
import sys
import unicodedata
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.samples import fitted, labelled_sample

END = "$"
SHORTEST, LONGEST = 4, 12
SHORTEST_UNSPACED = 2
FUZZY_FROM = 5
SWAP = 2
FOLDS = 10
_TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")

# Fixed values of Unicode: blocks of scripts that put no blanks between words, and marks that belong to the letter before.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f"
    "\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f"
    "\U00020000-\U0003ffff"
)
_MARKS = "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M")
_PART = re.compile(rf"(?:[^\W_{_UNSPACED}][{_MARKS}]*)+|(?![\W_])[{_UNSPACED}]")
_OF_UNSPACED = re.compile(rf"[{_UNSPACED}]")
_QUOTES = re.compile("[\"“”„«»‹›‘’]|(?<!\\w)'|'(?!\\w)")
_REMEMBERED, _REMEMBERED_CHARS = 200_000, 64


@dataclass
class Automaton:
    """The Levenshtein automaton of up to one edit, intersected with a trie of terms; states are made on demand.

    With ``swaps``, two neighbouring letters that changed places are one edit. Places are (node, edits), or (node, SWAP) after
    the second of two such letters, where the node is that of both.
    """

    terms: list[str]
    swaps: bool = False
    exact: list[dict] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    before: list[str] = field(default_factory=list, repr=False)
    states: dict = field(default_factory=dict, repr=False)
    places: list[frozenset] = field(default_factory=list, repr=False)
    moves: list[dict] = field(default_factory=list, repr=False)
    found: list[dict] = field(default_factory=list, repr=False)

    def __post_init__(self):
        self.exact, self.ends, self.before = [{}], [-1], [""]
        for number, term in enumerate(self.terms):
            node, last = 0, ""
            for char in term:
                if char not in self.exact[node]:
                    self.exact[node][char] = len(self.exact)
                    self.exact.append({})
                    self.ends.append(-1)
                    self.before.append(last)
                last = char
                node = self.exact[node][char]
            self.ends[node] = number
        self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The state for (node, edits) places: a letter of the term may be left out, and fewer edits hide more."""
        places = places | {(child, 1) for node, edits in places if not edits for child in self.exact[node].values()}
        fewest: dict[int, int] = {}
        for node, edits in places:
            if edits != SWAP:
                fewest[node] = min(edits, fewest.get(node, 1))
        frozen = frozenset(fewest.items()) | {place for place in places if place[1] == SWAP}
        if frozen not in self.states:
            self.states[frozen] = len(self.moves)
            self.places.append(frozen)
            self.moves.append({})
            ended = {self.ends[node]: edits for node, edits in frozen if edits != SWAP and self.ends[node] >= 0}
            self.found.append({n: e for n, e in ended.items() if not e or len(self.terms[n]) >= FUZZY_FROM})
        return self.states[frozen]

    def _move(self, state: int, char: str) -> int:
        after = set()
        for node, edits in self.places[state]:
            if edits == SWAP:
                if char == self.before[node]:
                    after.add((node, 1))
                continue
            for letter, child in self.exact[node].items():
                if letter == char:
                    after.add((child, edits))
                elif not edits:
                    after.add((child, 1))
                    if self.swaps and char != END and char in self.exact[child]:
                        after.add((self.exact[child][char], SWAP))
            if not edits:
                after.add((node, 1))
        self.moves[state][char] = to = self._state(after) if after else -1
        return to

    def reached(self, word: str, start: int = 0, ends: frozenset[int] = frozenset()) -> dict[int, tuple[int, int]]:
        """Terms that the word from ``start`` on, or a beginning of that, is within one edit of: the edits, and the last place
        that has them. Besides its own end, the word has ends at ``ends``."""
        state, found, moves, length = 0, {}, self.moves, len(word)
        for place in range(start, length + 1):
            inside = place < length
            if inside and place in ends and place > start:
                ended = moves[state].get(END)
                ended = self._move(state, END) if ended is None else ended
                for term, edits in self.found[ended].items() if ended >= 0 else ():
                    found[term] = min((edits, -place), found.get(term, (1, 0)))
            char = word[place] if inside else END
            to = moves[state].get(char)
            state = self._move(state, char) if to is None else to
            if state < 0:
                break
            if self.found[state]:
                for term, edits in self.found[state].items():
                    found[term] = min((edits, -place - inside), found.get(term, (1, 0)))
        return {term: (edits, -place) for term, (edits, place) in found.items()} if found else found

    def hits(self, word: str) -> dict[int, int]:
        """Terms that the word, or a beginning of it, is within one edit of, and the edits."""
        return {term: edits for term, (edits, _) in self.reached(word).items()}


def parts(token: str) -> list[tuple[int, int]]:
    """Where the runs of letters and digits of a token, and its single letters of scripts without blanks, begin and end."""
    if token.isascii() and token.isalnum():
        return [(0, len(token))]
    return [match.span() for match in _PART.finditer(token)]


def begins(token: str) -> tuple[tuple[str, tuple[str, ...] | None], ...]:
    """For every place in a token where a term may begin: what follows, up to the length of the longest term, and the words
    that end there: the run of letters and digits, and the rest of the token; none in scripts without blanks, and none that
    are longer than any word."""
    found = []
    for start, end in parts(token):
        begun = token[start : start + LONGEST]
        if _OF_UNSPACED.match(begun):
            found.append((begun, None))
            continue
        run = token[start:end]
        digits = run.isdigit()
        if not digits or end < len(token):
            rest = [token[start:]] if len(token) - start <= _REMEMBERED_CHARS else []
            wholes = rest if digits or end == len(token) or end - start > _REMEMBERED_CHARS else [run, *rest]
            found.append((begun, tuple(wholes)))
    return tuple(found)


class _Begins(dict):
    """``begins`` of the tokens asked for last; each token is looked into once for all its uses."""

    def __missing__(self, token: str) -> tuple[tuple[str, tuple[str, ...] | None], ...]:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[token] = begins(token)
        return found


def tokens(text: str) -> list[str]:
    """Lower-cased words from their first letter or digit to their last; equal words are one object."""
    return [sys.intern(token) for token in _TOKEN.findall(text.lower())]


def variant(token: str, start: int, to: int, inside: list[tuple[int, int]]) -> str:
    """The word of a hit from ``start`` to ``to``: up to the end of the last part that it reaches into."""
    last = bisect_left(inside, (max(to, start + 1),)) - 1  # parts stand in order and apart
    return token[start : inside[last][1]]


def misspelled(automaton: Automaton, token: str) -> set[tuple[int, str]]:
    """The terms that the token holds with an edit, and the words that stand for them."""
    inside = parts(token)
    ends = frozenset(end for _, end in inside)
    return {
        (term, variant(token, start, to, inside))
        for start, _ in inside
        for term, (edits, to) in automaton.reached(token, start, ends).items()
        if edits
    }


@dataclass
class ToxicityModel:
    """Terms, the weight of an exact and of a misspelled hit of each, the words that are no misspelling of a term as clean
    documents show them, and the regression over document features."""

    terms: list[str]
    weights: np.ndarray
    fuzzy: np.ndarray
    least: np.ndarray
    clean: frozenset[tuple[int, str]] = frozenset()
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(4))
    window: int = 8
    quoted: float = 0.35
    crowded: float = 0.25
    threshold: float = 0.7
    automaton: Automaton | None = field(default=None, repr=False, compare=False)
    remembered: dict = field(default_factory=dict, repr=False, compare=False)

    def word(self, word: str) -> tuple[tuple[int, int, int, float], ...]:
        """The best terms that a token holds, none over another: part of the token, place in it, term and weight."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms, swaps=True)
        if word in self.remembered:
            return self.remembered[word]
        inside = parts(word)
        ends = frozenset(end for _, end in inside)
        found = []
        for part, (start, _) in enumerate(inside):
            best = None
            for term, (edits, to) in self.automaton.reached(word, start, ends).items():
                if edits and (term, variant(word, start, to, inside)) in self.clean:
                    continue
                weight = float(self.fuzzy[term] if edits else self.weights[term])
                if weight > 0 and (best is None or (weight, -term) > (best[3], -best[2])):
                    best = (part, start, term, weight)
            if best:
                found.append(best)
        if len(found) > 1:
            found = self._apart(found)
        hits = tuple(found)
        if len(word) <= _REMEMBERED_CHARS:
            if len(self.remembered) >= _REMEMBERED:
                self.remembered.clear()
            self.remembered[word] = hits
        return hits

    def _apart(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The hits that lie over no heavier one, in their order."""
        taken: set[int] = set()
        apart = []
        for hit in sorted(found, key=lambda hit: (-hit[3], hit[1])):
            span = range(hit[1], hit[1] + len(self.terms[hit[2]].rstrip(END)))
            if taken.isdisjoint(span):
                taken.update(span)
                apart.append(hit)
        return sorted(apart)

    def features(self, text: str | None) -> np.ndarray:
        """Sum, greatest and density of the hits' scores of a whole text, after a constant."""
        lowered = (text or "").lower()
        words = _TOKEN.findall(lowered)
        hits = {word: hit for word in set(words) if (hit := self.word(word))}
        if not hits:
            return np.array([1.0, 0.0, 0.0, 0.0])
        uses = Counter()
        for word in words:
            for hit in hits.get(word, ()):
                uses[hit[2]] += 1
        spans, place = [], 0
        sizes = {word: len(parts(word)) for word in set(words)}
        for match in _TOKEN.finditer(lowered):
            for part, start, term, weight in hits.get(match.group(), ()):
                if uses[term] >= self.least[term]:
                    begin = match.start() + start
                    end = min(match.end(), begin + len(self.terms[term].rstrip(END)))
                    spans.append((place + part, begin, end, weight))
            place += sizes[match.group()]
        if not spans:
            return np.array([1.0, 0.0, 0.0, 0.0])
        quotes = np.array([match.start() for match in _QUOTES.finditer(lowered)], dtype=np.int64)
        places = np.array([span[0] for span in spans])
        near = np.searchsorted(places, places + self.window, "right") - np.searchsorted(places, places - self.window) - 1
        scores = np.array([span[3] for span in spans]) * (1 + self.crowded * np.minimum(near, 4))
        if len(quotes):
            reach = 8 * self.window  # characters that a window of words usually covers
            starts, ends = np.array([span[1] for span in spans]), np.array([span[2] for span in spans])
            before = np.searchsorted(quotes, starts)
            opened = before > np.searchsorted(quotes, starts - reach)
            closed = np.searchsorted(quotes, ends + reach) > np.searchsorted(quotes, ends)
            scores = np.where(opened & closed & (before % 2 == 1), scores * self.quoted, scores)
        total = float(scores.sum())
        return np.array([1.0, math.log1p(total), float(scores.max()), math.log1p(100 * total / (place + 20))])

    def score(self, text: str | None) -> float:
        """How likely the whole text is toxic, 0 to 1."""
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.coefficients, -35, 35))))


def _known_unspaced(documents: list[list[str]], support: int, begun_by: _Begins) -> set[str]:
    """Beginnings in scripts without blanks that ``support`` documents show, each drawn out from one that they show."""
    known: set[str] = set()
    last: set[str] | None = None
    for length in range(SHORTEST_UNSPACED, LONGEST + 1):
        counts: Counter = Counter()
        for words in documents:
            begun = {
                rest[:length]
                for word in set(words)
                if not word.isascii()
                for rest, wholes in begun_by[word]
                if wholes is None and len(rest) >= length
            }
            counts.update(x for x in begun if last is None or x[:-1] in last)
        last = {x for x, n in counts.items() if n >= support}
        if not last:
            break
        known |= last
    return known


def _candidates(words: list[str], known: set[str], begun_by: _Begins) -> tuple[set[str], set[str]]:
    """Words and beginnings of words that occur, and those that occur twice or more; in scripts without blanks, of ``known``."""
    seen: Counter = Counter()
    for word, n in Counter(words).items():
        for rest, wholes in begun_by[word]:
            for whole in wholes or ():
                seen[whole + END] += n
            for length in range(SHORTEST_UNSPACED if wholes is None else SHORTEST, len(rest) + 1):
                if wholes is None and rest[:length] not in known:
                    break
                seen[rest[:length]] += n
    return set(seen), {term for term, n in seen.items() if n > 1}


def _tail(v: int, n: int, share: float) -> float:
    """The probability of ``v`` or more of ``n`` at ``share``."""
    return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(v, min(n, v + 60) + 1))


def learn_lexicon(toxic: list[list[str]], clean: list[list[str]], support: int = 3, chance: float = 0.3) -> dict:
    """{term: (weight, least uses in a document)} of terms that show toxic documents.

    A term is taken if, of all terms that as many documents show, fewer than ``chance`` would be expected to be as
    one-sided by luck, and nine in ten documents that show it are toxic. Beginnings make the longer terms that they cover
    needless, and are then drawn out as far as nearly all documents that show them agree, so that a misspelling has
    something to be compared with.
    """
    share = len(toxic) / max(1, len(toxic) + len(clean))
    begun_by = _Begins()
    known = _known_unspaced(toxic, support, begun_by)
    taken: dict[str, tuple[float, int, float]] = {}
    shown: dict[int, Counter] = {}
    for least in (1, 2):
        shown[least] = mine = Counter()
        for words in toxic:
            mine.update(_candidates(words, known, begun_by)[least - 1])
        shown[least] = mine = Counter({term: v for term, v in mine.items() if v >= support})
        others: Counter = Counter()
        for words in clean:
            others.update(mine.keys() & _candidates(words, known, begun_by)[least - 1])
        alike = Counter(v + others[term] for term, v in mine.items())
        for term, v in mine.items():
            n = v + others[term]
            if v < 0.9 * n:
                continue
            expected = alike[n] * _tail(v, n, share) / max(_tail(support, n, share), 1e-300)
            if expected < chance:
                weight = math.log((v + 0.5) / (len(toxic) + 1)) - math.log((others[term] + 0.5) / (len(clean) + 1))
                if term not in taken or taken[term][0] < weight:
                    taken[term] = (weight, least, v)
    kept: dict[str, tuple[float, int]] = {}
    for term in sorted(taken, key=lambda x: (len(x.rstrip(END)), x.endswith(END), x)):
        weight, least, v = taken[term]
        stem = term.rstrip(END)
        covered = any(stem[:i] in kept and kept[stem[:i]][1] <= least for i in range(SHORTEST_UNSPACED, len(stem) + 1))
        if not covered:
            kept[term] = (weight, least)
    longer: dict[int, dict[str, list[str]]] = {1: {}, 2: {}}
    for least, counts in shown.items():
        for term in counts:
            if not term.endswith(END):
                longer[least].setdefault(term[:-1], []).append(term)

    def drawn_out(term: str, least: int) -> str:
        while True:
            more = [x for x in longer[least].get(term, []) if shown[least][x] >= 0.95 * shown[least][term]]
            if term.endswith(END) or not more or _OF_UNSPACED.match(term):
                return term
            term = max(more, key=lambda x: shown[least][x])

    return {drawn_out(term, least): (weight, least) for term, (weight, least) in kept.items()}


def train(sample: list[tuple[int, str]], rounds: int = 40) -> ToxicityModel:
    """Fit lexicon, weights of misspelled hits and regression on (toxic, text) pairs."""
    toxic = [tokens(text) for label, text in sample if label]
    clean = [tokens(text) for label, text in sample if not label]
    lexicon = learn_lexicon(toxic, clean)
    terms = sorted(lexicon)
    weights = np.array([lexicon[term][0] for term in terms])
    model = ToxicityModel(terms, weights, np.zeros(len(terms)), np.array([lexicon[term][1] for term in terms]))
    automaton = Automaton(terms, swaps=True)
    model.automaton = automaton
    # A misspelled hit has half of its term's weight, unless clean documents of the sample show the word: it is taken for a
    # misspelling then only if, as with terms, nine in ten documents that show it are toxic.
    model.fuzzy = 0.5 * weights
    near = [{hit for word in set(words) for hit in misspelled(automaton, word)} for words in toxic + clean]
    of_toxic, of_clean = (Counter(hit for hits in some for hit in hits) for some in (near[: len(toxic)], near[len(toxic) :]))

    def known_clean(n: Counter) -> frozenset[tuple[int, str]]:
        return frozenset(hit for hit, k in n.items() if of_toxic[hit] < 0.9 * (of_toxic[hit] + k))

    # New documents hold clean words that the sample lacks. For the regression, a clean document is one: in turn, a tenth of
    # them count as unseen.
    texts = [text for label, text in sample if label] + [text for label, text in sample if not label]
    fold = [-1] * len(toxic) + [i % FOLDS for i in range(len(clean))]
    x = np.zeros((len(texts), 4))
    for turn in range(-1, FOLDS):
        unseen = Counter(hit for hits, f in zip(near, fold, strict=True) if f == turn >= 0 for hit in hits)
        model.clean = known_clean(of_clean - unseen)
        model.remembered.clear()
        for i, text in enumerate(texts):
            if fold[i] == turn:
                x[i] = model.features(text)
    model.clean = known_clean(of_clean)
    model.remembered.clear()
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ model.coefficients, -35, 35)))
        gradient = x.T @ (y - p) - ridge @ model.coefficients
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge
        model.coefficients = model.coefficients + np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    if not len(sample):
        model.coefficients = np.array([-35.0, 0.0, 0.0, 0.0])
    return model


def fit_toxicity_model(
    labels: DataFrame,
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = 2500,
    chars: int = 20_000,
) -> ToxicityModel:
    """Fit on at most ``per_label`` documents of each label, ``chars`` characters of each."""
    return fitted(labelled_sample(labels, documents, key, F.col(label), text, per_label, 2, chars), train, ToxicityModel)


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """The score of a whole text, 0 to 1. A null or empty text has the score of a text without hits."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text if isinstance(text, str) else None) for text in texts], dtype="float64")

    model.automaton = None  # made anew by each task
    model.remembered = {}
    return score(text)
