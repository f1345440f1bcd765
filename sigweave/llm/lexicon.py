"""A lexicon trie read through Levenshtein automata.

The states of the automata of all terms are run together: a state is a set of (trie node, edits
spent).  Sets are made when a text first needs them and kept, so reading a word is one look-up per
character until no term is left.  Characters that no term has are one and the same to the automata,
and when the sets kept reach a bound they are all forgotten and made anew as needed.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    """A word or the beginning of words, with the number of edits in which a spelling may differ."""

    text: str
    edits: int


def default_edits(text: str) -> int:
    return 0 if len(text) < 4 else 1 if len(text) < 9 else 2


#: Stands for every character that is in no term.
OTHER = ""


class Automaton:
    """Finds the terms that a word begins with, misspelled or not, at any character.

    ``most`` bounds the moves between sets that are remembered, and with them the sets.
    """

    def __init__(self, terms: list[Term], most: int = 200_000):
        self.terms, self.most = terms, most
        self.alphabet = frozenset(c for t in terms for c in t.text)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.edits: list[int] = [0]  # most edits of any term below
        for number, term in enumerate(terms):
            node = 0
            for c in term.text:
                self.edits[node] = max(self.edits[node], term.edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.edits.append(0)
                node = self.children[node][c]
            self.edits[node] = max(self.edits[node], term.edits)
            self.ends[node] = number
        self._forget()

    def _forget(self) -> None:
        start = self._closed({(0, 0)})
        self.made = 0
        self.states: list[frozenset[tuple[int, int]]] = [start]
        self.known = {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.matches: list[tuple[int, int] | None] = [None]

    def _closed(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the characters of terms that the word left out."""
        work, out = list(state), set(state)
        while work:
            node, spent = work.pop()
            for child in self.children[node].values():
                if spent < self.edits[child] and (child, spent + 1) not in out:
                    out.add((child, spent + 1))
                    work.append((child, spent + 1))
        least: dict[int, int] = {}
        for node, spent in out:
            least[node] = min(spent, least.get(node, spent))
        return frozenset(least.items())

    def _move(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, spent in self.states[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], spent))
            if spent < self.edits[node]:
                after.add((node, spent + 1))
            after.update((child, spent + 1) for child in self.children[node].values() if spent < self.edits[child])
        closed = self._closed(after) if after else frozenset()
        if closed not in self.known:
            self.known[closed] = len(self.states)
            self.states.append(closed)
            self.moves.append({})
            ends = [(spent, self.ends[node]) for node, spent in closed if self.ends[node] is not None and spent <= self.terms[self.ends[node]].edits]
            self.matches.append(min(ends) if ends else None)
        self.moves[state][c] = self.known[closed]
        self.made += 1
        return self.known[closed]

    def match(self, word: str) -> tuple[int, int] | None:
        """``(edits, term)`` with the fewest edits; None if no term fits the beginning of the word."""
        if self.made >= self.most:
            self._forget()
        state, best = 0, None
        for c in word:
            c = c if c in self.alphabet else OTHER
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.states[state]:
                return best
            found = self.matches[state]
            if found is not None and (best is None or found < best):
                best = found
                if not best[0]:
                    return best
        return best
