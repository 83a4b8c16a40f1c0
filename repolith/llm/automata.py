"""Minimal acyclic automata over sorted words, with a perfect hash and search with one error."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Automaton:
    """The least deterministic acyclic automaton of distinct words, given in code-point order.

    Each arc holds how many words come before those through it, so that the way of a word
    adds up to its number in the order.  States are numbers; ``arcs[s]`` is a dict of
    symbol to (state, words before); ``final`` tells at which states a word ends.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # the last word's states that may still get arcs: for each, its arcs and whether a word ends there
        way: list[tuple[list[tuple[str, int]], bool]] = [([], False)]
        last = ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            self._fold(way, last, same, known)
            way.extend(([], False) for _ in word[same:])
            way[-1] = (way[-1][0], True)
            last = word
        self._fold(way, last, 0, known)
        self.root = self._state(*way[0], known)

    def _fold(self, way: list, last: str, keep: int, known: dict) -> None:
        for k in range(len(last), keep, -1):
            state = self._state(*way.pop(), known)
            way[-1][0].append((last[k - 1], state))

    def _state(self, arcs: list[tuple[str, int]], final: bool, known: dict) -> int:
        sign = (final, *arcs)
        state = known.get(sign)
        if state is None:
            state = known[sign] = len(self.arcs)
            before, out = int(final), {}
            for symbol, to in arcs:
                out[symbol] = (to, before)
                before += self.size[to]
            self.arcs.append(out)
            self.final.append(final)
            self.size.append(before)
        return state

    def walk(self, word: str, first: int, state: int, number: int) -> tuple[int, int]:
        """(state, number) after ``word[first:]`` from ``state``; state is -1 where the way ends."""
        arcs = self.arcs
        for symbol in word[first:]:
            step = arcs[state].get(symbol)
            if step is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int:
        """Place of ``word`` in the order, -1 if it isn't held."""
        state, number = self.walk(word, 0, self.root, 0)
        return number if state >= 0 and self.final[state] else -1

    def one_more(self, word: str, exact: int) -> Iterator[int]:
        """Numbers of the words that start with ``word[:exact]`` and differ from ``word`` by one error after it.

        The error is one symbol put in, or one replaced by a later one; each pair of words
        is so found from one of its two ends.  It stands at the first place where the words
        differ, hence no word comes twice.
        """
        arcs, final = self.arcs, self.final
        state, number = self.walk(word[:exact], 0, self.root, 0)
        if state < 0:
            return
        end = len(word)
        for k in range(exact, end + 1):
            here = word[k] if k < end else ""
            for symbol, (to, before) in arcs[state].items():
                if symbol == here:
                    continue
                at, found = self.walk(word, k, to, number + before)  # put in
                if at >= 0 and final[at]:
                    yield found
                if symbol > here and k < end:
                    at, found = self.walk(word, k + 1, to, number + before)  # replaced
                    if at >= 0 and final[at]:
                        yield found
            if k == end or here not in arcs[state]:
                return
            step = arcs[state][here]
            state, number = step[0], number + step[1]
