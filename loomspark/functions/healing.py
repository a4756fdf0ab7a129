"""Fuzzy recovery of CSS selectors whose page has changed.

Every element is scored against the selector: points earned over points asked,
one per constraint (``*`` asks for nothing) and one per combinator.  All elements at
the highest score are returned if it reaches the minimum.  Scores, and the best
scores above and before an element, are memoised by element and compound, so work
is bounded by their product.
"""

from __future__ import annotations

from .dom import Chain, Element, Simple, compile_selector, select

EPSILON = 1e-9
DEFAULT_MIN = 0.8


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1.0 - levenshtein(a, b) / longest


def _points(e: Element, s: Simple) -> float:
    if s.kind == "id":
        return similarity(e.attrs["id"], s.name) if "id" in e.attrs else 0.0
    if s.kind == "class":
        return max((similarity(c, s.name) for c in e.attrs.get("class", "").split()), default=0.0)
    if s.kind == "attr":
        if s.name not in e.attrs:
            return 0.0
        return 1.0 if s.matches(e) else similarity(e.attrs[s.name], str(s.value)) if s.op else 1.0
    return float(s.matches(e))


class _Scorer:
    def __init__(self, chain: Chain) -> None:
        self.compounds, self.links = [[s for s in c if s.kind != "tag" or s.name != "*"] for c in chain[0]], chain[1]
        self.whole: dict[tuple[int, int], float] = {}
        self.best: dict[tuple[int, int], float | None] = {}
        #: Points that the compounds up to k ask for.
        self.asked = [0.0]
        for k, c in enumerate(self.compounds):
            self.asked.append(self.asked[-1] + len(c) + (k > 0))

    def _left(self, e: Element, k: int) -> float | None:
        """Best points of compounds up to ``k`` on the left side of ``e``; the nearest element unless another is strictly better."""
        link = self.links[k]
        up = link in (" ", ">")

        def nearest(x: Element) -> Element | None:
            if up:
                return x.parent if x.parent is not None and x.parent.parent is not None else None
            return x.parent.elements[x.index - 1] if x.parent is not None and x.index else None

        if link in (">", "+"):
            x = nearest(e)
            return None if x is None else self.earned(x, k)
        # walk to the first element whose best is known, and fill in the way back
        way, x = [], e
        while x is not None and (x.order, k) not in self.best:
            way.append(x)
            x = nearest(x)
        for x in reversed(way):
            near = nearest(x)
            if near is None:
                self.best[x.order, k] = None
                continue
            own, far = self.earned(near, k), self.best[near.order, k]
            self.best[x.order, k] = far if far is not None and far > own + EPSILON else own
        return self.best[e.order, k]

    def earned(self, e: Element, k: int) -> float:
        key = (e.order, k)
        if key not in self.whole:
            p = sum(_points(e, s) for s in self.compounds[k])
            if k:
                left = self._left(e, k - 1)
                p += 0.0 if left is None else left + 1.0
            self.whole[key] = p
        return self.whole[key]

    def score(self, e: Element) -> float:
        k = len(self.compounds) - 1
        return self.earned(e, k) / self.asked[k + 1] if self.asked[k + 1] else 0.0


def heal(root: Element, selector: str, minimum: float = DEFAULT_MIN) -> list[Element]:
    """All elements that tie at the highest score, in document order; none if it is below the minimum or zero."""
    scorers = [_Scorer(c) for c in compile_selector(selector)]
    elements = list(root.descendants())
    scores = [max(s.score(e) for s in scorers) for e in elements]
    top = max(scores, default=0.0)
    if top <= EPSILON or top + EPSILON < minimum:
        return []
    return [e for e, v in zip(elements, scores, strict=True) if v >= top - EPSILON]


def find(root: Element, selector: str, healing: bool = False, minimum: float = DEFAULT_MIN) -> list[Element]:
    """The exact matches, or, if there are none and healing is asked for, the healed ones."""
    return select(root, selector) or (heal(root, selector, minimum) if healing else [])
