"""A generalised suffix automaton over sequences of integers."""

from __future__ import annotations

from collections import defaultdict


class SuffixAutomaton:
    """All substrings of the sequences added so far.

    A state stands for the substrings that end at the same places; ``length``
    is that of its longest, and ``link`` leads to the state of the longest
    suffix that ends at more places.
    """

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.step: dict[int, int] = {}
        self.out: list[list[int]] = [[]]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int) -> int:
        self.out.append([])
        self.link.append(-1)
        self.length.append(length)
        return len(self.link) - 1

    def _go(self, state: int, symbol: int, to: int) -> None:
        key = state * self.symbols + symbol
        if key not in self.step:
            self.out[state].append(symbol)
        self.step[key] = to

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state reached from p, cut to the substrings that p's longest makes."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1)
        for s in self.out[q]:
            self._go(clone, s, self.step[q * self.symbols + s])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.step.get(p * self.symbols + symbol) == q:
            self._go(p, symbol, clone)
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            q = self.step.get(last * self.symbols + symbol)
            if q is not None:
                last = self._split(last, symbol, q)
                continue
            new, p = self._state(self.length[last] + 1), last
            while p >= 0 and p * self.symbols + symbol not in self.step:
                self._go(p, symbol, new)
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._split(p, symbol, self.step[p * self.symbols + symbol])
            last = new

    def above(self, state: int, length: int) -> int:
        """The state that stands for the last ``length`` symbols of a state's substrings."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class ItemIndex:
    """The windows of test items, found by streaming words through their automaton.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item.
    """

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window = window
        self.words = sorted({w for _, words in items for w in words})
        number = {w: k for k, w in enumerate(self.words)}
        coded = [(item, [number[w] for w in words]) for item, words in items if words]
        self.automaton = a = SuffixAutomaton(max(1, len(self.words)))
        for _, codes in coded:
            a.add(codes)
        self.shortest = min((min(len(codes), window) for _, codes in coded), default=window)
        self.pairs = sorted({x * a.symbols + y for _, codes in coded for x, y in zip(codes, codes[1:])})
        #: items of each single-word window
        self.single: dict[int, set] = defaultdict(set)
        #: items of each state's windows of full length, and (length, items) of the shorter windows
        self.full: dict[int, set] = defaultdict(set)
        short: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for item, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = a.step[state * a.symbols + c]
                if i + 1 >= window:
                    self.full[a.above(state, window)].add(item)
            if len(codes) == 1:
                self.single[codes[0]].add(item)
            elif len(codes) < window:
                short[a.above(state, len(codes))][len(codes)].add(item)
        #: for each state the state of its last ``window`` symbols
        self.anchor = [a.above(s, window) if a.length[s] >= window else -1 for s in range(len(a.link))]
        #: for each state the shorter windows that its substrings can end with
        self.short: list[list[tuple[int, set]]] = [[] for _ in a.link]
        for s in sorted(range(1, len(a.link)), key=lambda s: a.length[s]):
            self.short[s] = self.short[a.link[s]] + list(short[s].items()) if s in short else self.short[a.link[s]]
        a.out = []

    def stream(self, codes: list[int], begin: int, hit, found: set) -> None:
        """Feed words; mark in ``hit`` (from ``begin`` on) those inside a window, gather the items."""
        step, link, length, symbols, window = self.automaton.step, self.automaton.link, self.automaton.length, self.automaton.symbols, self.window
        state = matched = 0
        for i, c in enumerate(codes):
            to = step.get(state * symbols + c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step.get(state * symbols + c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                hit[begin + i + 1 - matched : begin + i + 1] = True
                found |= self.full[self.anchor[state]]
            for size, items in self.short[state]:
                if size <= matched:
                    hit[begin + i + 1 - size : begin + i + 1] = True
                    found |= items
