"""Cheapest edits of a conversation by iterative-deepening A* (plain Python, one conversation or one stretch of it).

The roles a conversation may have are ``(s?(ua)+)?``, read by four states: nothing yet, after the system
turn, after a user, after an assistant. Edits are tried in ASCII order (Delete, Insert, Keep, Rerole) depth
first under a bound on the cost, which rises by one until a path is accepted: that path is the cheapest, and
among the cheapest the first in ASCII order. A table of (row, state) with the largest budget known to fail is
kept over all bounds, so no failed state is searched twice with the same means.
"""

from __future__ import annotations

from collections.abc import Sequence

START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> {initial: next state}
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: state -> state after an inserted or rewritten turn, and its role
TURN = [USER, USER, ASSISTANT, USER]
ROLE = ["user", "user", "assistant", "user"]
LEGAL_PAIRS = {"su", "ua", "au"}
SOUND, REMOVE, CUT_SHORT = range(3)      # a row's fault: none, blank or duplicate, truncated
DELETE, INSERT, REROLE, SHORT = 3, 2, 2, 1
NEVER = 1 << 60


class Stretch:
    """Rows given by the initial of their role ('' for none) and their fault."""

    def __init__(self, initials: Sequence[str], faults: Sequence[int]):
        self.initials, self.faults, self.n = initials, faults, len(initials)
        n = self.n
        self.fixed, self.after, self.heir = [0] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        # rows that cannot stay as they are cost an edit; a run of m neighbours that may not follow each
        # other costs an edit for every two of them, since an edit touches two neighbours at most
        self.runs, self.run, self.rest = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = self.after[i + 1]
            self.heir[i] = self.heir[i + 1]
            if faults[i] == REMOVE:
                self.fixed[i], self.after[i] = self.fixed[i + 1] + DELETE, j
                continue
            self.after[i] = i
            self.fixed[i] = self.fixed[i + 1] + (SHORT if faults[i] == CUT_SHORT else 0)
            if initials[i] not in ("u", "a"):
                self.fixed[i] += REROLE
                self.heir[i] |= initials[i] == "s"
                self.runs[i] = self.runs[j]
            elif j < n and initials[j] == initials[i]:
                self.run[i], self.rest[i] = self.run[j] + 1, self.rest[j] if self.run[j] else self.runs[j]
                self.runs[i] = 2 * (-(-self.run[i] // 2)) + self.rest[i]
            else:
                self.runs[i] = self.runs[j]

    def least(self, pos: int, state: int, goal: int | None) -> int:
        """A cost that no way from here can go below. ``goal``: the state to end in, or None for the end of
        a conversation, where turns may still be inserted."""
        if goal == START:
            return DELETE * (self.n - pos) if state == START else NEVER
        if goal == SYSTEM:
            if state == SYSTEM:
                return DELETE * (self.n - pos)
            return DELETE * (self.n - pos - 1) if state == START and self.heir[pos] else NEVER
        j = self.after[pos]
        if j == self.n:
            return self.fixed[pos] + ((0, 4, 2, 0)[state] if goal is None else 0)
        first, cost = self.initials[j], self.fixed[pos]
        if first in ("u", "a") and (first == "u") == (state == USER):
            m = 1 + self.run[j]
            cost += 2 * (-(-m // 2)) + (self.rest[j] if self.run[j] else self.runs[j])
        else:
            cost += self.runs[j]
        return cost - (REROLE if state == START and self.heir[pos] else 0)   # one system turn may stay first

    def moves(self, pos: int, state: int, goal: int | None) -> list[tuple[str, int, int, int]]:
        """(initial of the edit, cost, row, state), in ASCII order. A stretch with a goal ends with a row's edit."""
        here = pos < self.n
        out = [("D", DELETE, pos + 1, state)] if here else []
        if here or goal is None:
            out.append(("I", INSERT, pos, TURN[state]))
        if here and self.faults[pos] != REMOVE:
            short = SHORT if self.faults[pos] == CUT_SHORT else 0
            kept = NEXT[state].get(self.initials[pos])
            if kept is not None:
                out.append(("K", short, pos + 1, kept))
            out.append(("R", REROLE + short, pos + 1, TURN[state]))
        return out

    def cheapest(self, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
        """(cost, edits' initials), or None if the goal cannot be reached."""
        if not self.n:
            return ((0, 4, 2, 0)[entry], ("", "II", "I", "")[entry]) if goal is None else (0, "") if entry == goal else None
        failed: dict[int, int] = {}
        bound = max(0, self.least(0, entry, goal))
        while bound <= DELETE * self.n + 2 * INSERT + SHORT:
            audit = self._within(bound, entry, goal, failed)
            if audit is not None:
                return bound, audit
            bound += 1
        return None

    def _within(self, bound: int, entry: int, goal: int | None, failed: dict[int, int]) -> str | None:
        path: list[str] = []
        stack = [(0, entry, bound, iter(self.moves(0, entry, goal)))]
        while stack:
            pos, state, budget, todo = stack[-1]
            for edit, cost, p, s in todo:
                left = budget - cost
                if left < 0 or failed.get(p * 4 + s, -1) >= left or self.least(p, s, goal) > left:
                    continue
                path.append(edit)
                if p == self.n and (s in (START, ASSISTANT) if goal is None else s == goal):
                    return "".join(path)
                stack.append((p, s, left, iter(self.moves(p, s, goal))))
                break
            else:
                key = pos * 4 + state
                failed[key] = max(failed.get(key, -1), budget)
                stack.pop()
                if path:
                    path.pop()
        return None


def repaired_lines(audit: str, rows: Sequence[tuple[str, str]], state: int = START):
    """``role:text`` of every turn that stays or is inserted; rows are (role, text)."""
    at = 0
    for edit in audit:
        if edit == "I":
            yield f"{ROLE[state]}:"
            state = TURN[state]
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            yield f"{role}:{text}"
            state = NEXT[state][role[:1]]
        elif edit == "R":
            yield f"{ROLE[state]}:{text}"
            state = TURN[state]
