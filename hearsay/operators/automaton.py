"""An Aho-Corasick automaton over bytes, in arrays, that walks many texts side by side.

All terms are found in one walk, whatever their number. States are rows of one dense
table over the bytes that occur in terms (all others share a column), so a step is one look-up and fail links are
already folded in. Texts are cut into pieces of equal length that overlap by the
longest term; a step moves all pieces of a batch at once, so the loop runs over
the places of a piece, not over characters of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Bytes of one table: several tables together hold a longer list, each term in one of them.
TABLE_BYTES = 48 << 20
PIECE = 256
LANES = 1 << 16


@dataclass
class Automaton:
    """``step[state * width + column[byte]]`` is the next state; states are numbered by depth."""

    column: np.ndarray
    width: int
    step: np.ndarray
    term: np.ndarray  # the term that ends at a state, or -1
    shorter: np.ndarray  # the next state with a term among the proper suffixes, or 0
    ends: np.ndarray  # whether any term ends at a state
    longest: int


def split_terms(terms: list[bytes], table_bytes: int = TABLE_BYTES) -> list[np.ndarray]:
    """Places of the terms, in groups whose tables keep the bound (one term at least in each)."""
    width = len(set(b"".join(terms))) + 1
    sizes = np.fromiter((4 * width * len(t) for t in terms), np.int64, len(terms))
    group = np.cumsum(sizes) // table_bytes
    return [np.nonzero(group == g)[0] for g in np.unique(group)]


def build(terms: list[bytes], places: np.ndarray | None = None) -> Automaton:
    """The automaton of different, non-empty ``terms``; ``places`` are the numbers it reports for them."""
    places = np.arange(len(terms)) if places is None else places
    used = np.unique(np.frombuffer(b"".join(terms), np.uint8))
    column = np.zeros(256, np.int32)
    column[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    # Level by level: terms that agree so far share a state.
    order = sorted(range(len(terms)), key=terms.__getitem__)
    lengths = np.array([len(terms[k]) for k in order], np.int64)
    begins = np.cumsum(lengths) - lengths
    letters = column[np.frombuffer(b"".join(terms[k] for k in order), np.uint8)]
    at = np.zeros(len(terms), np.int64)  # the state of each term so far
    term, levels, n = [-1], [], 1
    for depth in range(int(lengths.max(initial=0))):
        live = np.nonzero(lengths > depth)[0]
        letter = letters[begins[live] + depth]
        # Terms are sorted, so equal beginnings stand together.
        new = np.ones(len(live), bool)
        new[1:] = (at[live[1:]] != at[live[:-1]]) | (letter[1:] != letter[:-1])
        state = n + np.cumsum(new) - 1
        levels.append((at[live[new]], letter[new], state[new]))
        at[live] = state
        n += int(new.sum())
        found = np.full(int(new.sum()), -1, np.int64)
        last = lengths[live] == depth + 1
        found[state[last] - state[0]] = places[np.array(order)[live[last]]]
        term.extend(found.tolist())
    term = np.array(term, np.int64)
    step, fail = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
    shorter, ends = np.zeros(n, np.int64), term >= 0
    for parents, letter, state in levels:
        # The fail state is shallower, so its row is done; the row starts as a copy of it.
        fail[state] = np.where(parents == 0, 0, step[fail[parents], letter])
        shorter[state] = np.where(term[fail[state]] >= 0, fail[state], shorter[fail[state]])
        ends[state] |= ends[fail[state]]
        step[parents, letter] = state
        step[state] = step[fail[state]]
    return Automaton(column, width, step.ravel(), term, shorter, ends, int(lengths.max(initial=0)))


def walk(machine: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (text, term) for the texts ``data[starts[i]:ends[i]]``, in order of text, then term."""
    if machine.longest == 0 or not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = max(PIECE, 4 * machine.longest)
    counts = np.maximum(-(-(ends - starts) // size), 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    begin = starts[owner] + size * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    # A piece also reads what a term that starts in it may still need.
    stop = np.minimum(begin + size + machine.longest - 1, ends[owner])
    columns = machine.column[data]
    codes = []
    states = len(machine.term)
    for lo in range(0, len(owner), LANES):
        lanes = slice(lo, lo + LANES)
        by_length = np.argsort(begin[lanes] - stop[lanes], kind="stable")
        first, whose = begin[lanes][by_length], owner[lanes][by_length]
        length = (stop[lanes] - begin[lanes])[by_length]
        state = np.zeros(len(first), np.int64)
        # The longest piece comes first, so pieces that are over fall off the end.
        live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for place, n in enumerate(live.tolist()):
            state = state[:n]
            state = machine.step[state * machine.width + columns[first[:n] + place]].astype(np.int64)
            hit = np.nonzero(machine.ends[state])[0]
            if len(hit):
                codes.append(whose[hit] * states + state[hit])
        codes = [np.unique(np.concatenate(codes))] if codes else []
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, state = codes[0] // states, codes[0] % states
    pairs = []
    while len(text):
        own = machine.term[state] >= 0
        pairs.append(np.column_stack((text[own], machine.term[state[own]])))
        state = machine.shorter[state]
        on = state > 0
        text, state = text[on], state[on]
    found = np.unique(np.concatenate(pairs), axis=0)
    return found[:, 0], found[:, 1]
