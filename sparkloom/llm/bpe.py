"""A byte-pair vocabulary as plain tables, with the two exact ways of encoding that the token operators use.

The tables come from a tokenizer file whose place is a parameter. A vocabulary made by merges has the property both ways
rest on: a token sequence is the encoding of its text exactly if each two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import heapq
import json

import regex

#: Places that pretokenize: what the two tokenizer files name as their patterns; fixed values.
GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"""
DIRECT = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens are ids; a piece of text is a list of unit ids (one per byte, the last one with the word end if there is one)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge[x, y] = rank, z
            self.parts[z] = x, y, rank
        letters = byte_letters()
        self.unit = [self.ids[c] for c in letters]
        self.last_unit = [self.ids[c + self.suffix] for c in letters]
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._units: dict[int, list[int]] = {}

    def units(self, piece: str) -> list[int]:
        body = piece.encode("utf-8")
        out = [self.unit[b] for b in body]
        if out:
            out[-1] = self.last_unit[body[-1]]
        return out

    def units_of(self, token: int) -> list[int]:
        if token not in self._units:
            self._units[token] = [token] if token not in self.parts else self.units_of(self.parts[token][0]) + self.units_of(self.parts[token][1])
        return self._units[token]

    # -------------------------------------------------------- merging

    def encode_units(self, units: list[int]) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals; n log n."""
        n = len(units)
        if n < 2:
            return list(units)
        tok, nxt, prv = list(units), [*range(1, n), -1], [*range(-1, n - 1)]
        merge = self.merge
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue
            tok[i], tok[j] = made, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if m := merge.get((made, tok[k])):
                    heapq.heappush(heap, (m[0], i, made, tok[k], m[1]))
            if (h := prv[i]) >= 0 and (m := merge.get((tok[h], made))):
                heapq.heappush(heap, (m[0], h, tok[h], made, m[1]))
        return [t for t in tok if t >= 0]

    # -------------------------------------------------------- tree concatenation

    def encode_tree(self, units: list[int]) -> list[int]:
        """Encode both halves, then join them."""
        if len(units) <= DIRECT:
            return self.encode_units(units)
        mid = len(units) // 2
        return self.join(self.encode_tree(units[:mid]), self.encode_tree(units[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from theirs.

        A window of tokens around the join is encoded anew and grows until its first token is the left side's and its
        last token the right side's; then every two neighbours of the result are an encoding, so the result is.
        """
        if not left or not right:
            return left + right
        wide = 4
        while True:
            a, b = min(wide, len(left)), min(wide, len(right))
            window = self.encode_units([u for t in left[-a:] + right[:b] for u in self.units_of(t)])
            agree_left = a == len(left) or window[0] == left[-a]
            agree_right = b == len(right) or window[-1] == right[b - 1]
            if agree_left and agree_right and (len(window) > 1 or a == len(left) or b == len(right)):
                return left[:-a] + window + right[b:]
            wide *= 2

    # -------------------------------------------------------- prefix dynamic programming

    def _spine(self, token: int, side: int, kept: dict) -> list:
        """(part, rank at which it is used up) of the parts that ever touch this end of the token, the token first."""
        if token not in kept:
            found, t, rank = [(token, 1 << 60)], token, 0
            while t in self.parts:
                rank, t = self.parts[t][2], self.parts[t][side]
                found.append((t, rank))
            kept[token] = found
        return kept[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the texts of a and b together is a, b: no merge across comes before theirs."""
        known = self._fits.get((a, b))
        if known is None:
            known, merge = True, self.merge
            left = self._spine(b, 0, self._left)
            for x, until in self._spine(a, 1, self._right):
                for y, used in left:
                    m = merge.get((x, y))
                    if m is not None and m[0] < until and m[0] <= used:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[a, b] = known
        return known


class PrefixCounter:
    """Exact token counts at every prefix of a text (no word-end suffix, GPT-style pieces)."""

    KEPT = 400_000

    def __init__(self, vocabulary: Vocabulary, pieces_of=None):
        """pieces_of(text): the tokenizer's own pieces, for texts with letters newer than some Unicode tables."""
        self.v = vocabulary
        self.pieces_of = pieces_of
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        whole = {t: i for t, i in vocabulary.ids.items() if t not in vocabulary.specials and vocabulary.encode_units(vocabulary.units_of(i)) == [i]}
        self.by_bytes = {bytes(byte_of[c] for c in t): i for t, i in whole.items()}
        sizes: dict[bytes, set[int]] = {}
        for t in self.by_bytes:
            if len(t) > 2:
                sizes.setdefault(t[-3:], set()).add(len(t))
        #: Lengths of the tokens that end in these three bytes; those of one and two bytes are always tried.
        self.lengths = {b: (*sorted(x, reverse=True), 2, 1) for b, x in sizes.items()}
        self._split = regex.compile(GPT_SPLIT)
        self.newer = regex.compile("[\u0500-\U0010ffff]")
        #: A run of white space with what follows it: pieces never reach over its start.
        self.unit = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
        self.space = regex.compile(r"\p{White_Space}+")
        self.pieces: dict[str, list[int]] = {}
        self.totals = _Totals(self)

    def piece(self, text: str) -> list[int]:
        """counts[i]: tokens of the first i bytes; each prefix's last token is the one that fits the prefix before it."""
        found = self.pieces.get(text)
        if found is not None:
            return found
        body = text.encode("utf-8")
        n, by_bytes, fits = len(body), self.by_bytes, self.v.fits
        last, counts = [0] * (n + 1), [0] * (n + 1)
        lengths = self.lengths
        for i in range(1, n + 1):
            for size in lengths.get(body[i - 3:i], (2, 1)) if i > 2 else (2, 1):
                j = i - size
                if j < 0:
                    continue
                t = by_bytes.get(body[j:i])
                if t is None:
                    continue
                if not j or fits(last[j], t):
                    last[i], counts[i] = t, counts[j] + 1
                    break
        if len(self.pieces) > self.KEPT:
            self.pieces.clear()
        if n <= 64:
            self.pieces[text] = counts
        return counts

    def split(self, text: str) -> list[str]:
        return self.pieces_of(text) if self.pieces_of and self.newer.search(text) else self._split.findall(text)

    def unit_total(self, unit: str) -> int:
        return sum(self.piece(p)[-1] for p in self.split(unit))

    def unit_counts(self, unit: str) -> list[int]:
        """counts[k]: tokens of the first k + 1 characters of a unit that begins a text or a run of white space."""
        out, before = [], 0
        lead = self.space.match(unit)
        run = lead.end() if lead else 0
        if run:
            out += self._by_char(unit[:run], self.piece(unit[:run]))
        at = 0
        for p in self.split(unit):
            counts = self._by_char(p, self.piece(p))
            if len(p) == 3 and p[0] == "'":  # half a contraction is two pieces
                counts[1] = sum(self.piece(q)[-1] for q in self.split(p[:2]))
            at += len(p)
            out += [before + c for k, c in enumerate(counts) if at - len(p) + k >= run]
            before += counts[-1]
        return out

    @staticmethod
    def _by_char(text: str, counts: list[int]) -> list[int]:
        if len(counts) == len(text) + 1:
            return counts[1:]
        ends, at = [], 0
        for c in text:
            at += len(c.encode("utf-8"))
            ends.append(counts[at])
        return ends

    def units(self, text: str) -> list[str]:
        """The units of a text in order; a special string stands alone."""
        if not any(s in text for s in self.v.specials):
            return self.unit.findall(text)
        return [u for part in self.v.split_specials.split(text) for u in ([part] if part in self.v.specials else self.unit.findall(part))]

    def count(self, units: list[str]) -> int:
        return sum(map(self.totals.__getitem__, units))

    def prefixes(self, text: str) -> list[int]:
        """counts[k]: tokens of text[:k + 1], as encoding that prefix alone would give."""
        out, before, units = [], 0, self.units(text)
        for k, u in enumerate(units):
            if u in self.v.specials:  # until it is whole, its letters continue what stands before
                held = "" if k == 0 or units[k - 1] in self.v.specials else units[k - 1]
                start = before - (self.totals[held] if held else 0)
                out += [start + c for c in self.unit_counts(held + u)[len(held):-1]] + [before + 1]
                before += 1
            else:
                out += [before + c for c in self.unit_counts(u)]
                before += self.totals[u]
        return out

    def within(self, units: list[str], budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens; only the unit that crosses the budget is looked into."""
        before = at = 0
        for k, u in enumerate(units):
            total = self.totals[u]
            if before + total > budget:
                if u in self.v.specials:
                    held = "" if k == 0 or units[k - 1] in self.v.specials else units[k - 1]
                    start = before - (self.totals[held] if held else 0)
                    counts = [start + c - before for c in self.unit_counts(held + u)[len(held):-1]]
                else:
                    counts = self.unit_counts(u)
                return at + max((j + 1 for j, c in enumerate(counts) if before + c <= budget), default=0)
            before, at = before + total, at + len(u)
        return at


class _Totals(dict):
    """Tokens of each whole unit met so far."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, unit: str) -> int:
        n = 1 if unit in self.counter.v.specials else self.counter.unit_total(unit)
        if len(self) > PrefixCounter.KEPT * 2:
            self.clear()
        if len(unit) <= 64:
            self[unit] = n
        return n
