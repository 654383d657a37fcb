"""Probabilistic alignment of a read to left flank, repeats of a motif, right flank; and motif detection. Plain numpy."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np


def viterbi_repeat(read: str, motif: str, left: str = "", right: str = "", match: float = 0.9, gap_open: float = 0.02, gap_extend: float = 0.3) -> dict:
    """score, path, copies, perfect, begin, end of the most probable walk through left flank, circular motif, right flank.

    The model has one state a base of each flank and of the motif, each with an insert state; deletions skip a base. The
    motif's last base goes back to its first or on to the right flank. Scores are natural logs. begin and end are the
    stretch of the read that the motif explains; copies how often its first base is passed.
    """
    bases = [*(("L", c) for c in left), *(("M", c) for c in motif), *(("R", c) for c in right)]
    n, m, nl, nm = len(read), len(bases), len(left), len(motif)
    if not n or not nm:
        return {"score": 0.0, "path": "", "copies": 0, "perfect": 0, "begin": 0, "end": 0}
    hit, miss = np.log(match), np.log((1 - match) / 3)
    opened, extended, on = np.log(gap_open), np.log(gap_extend), np.log(1 - 2 * gap_open)
    free = np.log(0.25)
    before: list[list[tuple[int, float]]] = [[] for _ in range(m)]
    for s in range(m):
        if s:
            before[s].append((s - 1, on))
        if s > 1:
            before[s].append((s - 2, opened))
    first, last = nl, nl + nm - 1
    before[first].append((last, on))
    if nm > 1:
        before[(first + 1)].append((last, opened))
        before[first].append((last - 1, opened))
    emit = lambda s, c: hit if bases[s][1] == c else miss
    match_score, ins_score = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
    back_m, back_i = np.zeros((n + 1, m), dtype=int), np.zeros((n + 1, m), dtype=int)
    starts = {0, first}
    for s in starts:
        match_score[1, s] = emit(s, read[0])
        back_m[1, s] = -1
    for i in range(2, n + 1):
        c = read[i - 1]
        for s in range(m):
            best, at = -np.inf, -1
            for p, cost in before[s]:
                for kind, table in ((0, match_score), (1, ins_score)):
                    v = table[i - 1, p] + cost
                    if v > best:
                        best, at = v, 2 * p + kind
            match_score[i, s], back_m[i, s] = best + emit(s, c), at
            a, b = match_score[i - 1, s] + opened, ins_score[i - 1, s] + extended
            ins_score[i, s], back_i[i, s] = max(a, b) + free, 2 * s + (b > a)
    ends = [m - 1, *(range(first, last + 1) if not right else [])] if right else list(range(first, last + 1))
    s = max(ends, key=lambda e: max(match_score[n, e], ins_score[n, e]))
    kind = int(ins_score[n, s] > match_score[n, s])
    score = float(max(match_score[n, s], ins_score[n, s]))
    path = []
    i = n
    while i > 0:
        path.append((s, kind))
        at = (back_i if kind else back_m)[i, s]
        i -= 1
        if at < 0:
            break
        s, kind = divmod(int(at), 2)
    path.reverse()
    inside = [i for i, (s, _) in enumerate(path) if first <= s <= last]
    copies = sum(1 for s, k in path if s == first and not k)
    text = "".join("I" if k else bases[s][0] for s, k in path)
    good, perfect, run = True, 0, 0
    for i in inside:
        s, k = path[i]
        if s == first and not k:
            run, good = 0, True
        good = good and not k and read[i] == bases[s][1]
        run += 1
        perfect += good and s == last and run == nm
    return {"score": score, "path": text, "copies": copies, "perfect": int(perfect), "begin": inside[0] if inside else 0, "end": inside[-1] + 1 if inside else 0}


def align_repeats(pairs: list[tuple[str, str]], match: float = 0.9, gap_open: float = 0.02, gap_extend: float = 0.3, cells: int = 1 << 23) -> list[tuple[int, int, float]]:
    """copies, perfect, score of viterbi_repeat for each pair (read, motif) without flanks.

    Pairs whose motifs are equally long walk through the model together, one base of all reads a step, the longest reads
    first, so that a step has those alone that go on. cells bounds the bases times states held at a time.
    """
    out, alike = [(0, 0, 0.0)] * len(pairs), defaultdict(list)
    for k, (read, motif) in enumerate(pairs):
        if read and motif:
            alike[len(motif)].append(k)
    for nm, places in alike.items():
        places.sort(key=lambda k: -len(pairs[k][0]))
        at = 0
        while at < len(places):
            part = places[at : at + max(1, cells // (len(pairs[places[at]][0]) * nm))]
            at += len(part)
            for k, result in zip(part, _align_alike([pairs[k][0] for k in part], [pairs[k][1] for k in part], match, gap_open, gap_extend)):
                out[k] = result
    return out


def _align_alike(reads: list[str], motifs: list[str], match: float, gap_open: float, gap_extend: float) -> list[tuple[int, int, float]]:
    """align_repeats for reads sorted from long to short and motifs of one length."""
    codes = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.array([len(r) for r in reads])
    n, b, nm = int(length[0]), len(reads), len(motifs[0])
    unit, base = np.stack([codes(m) for m in motifs]), np.zeros((n, b), dtype=np.uint32)
    for k, r in enumerate(reads):
        base[: len(r), k] = codes(r)
    active = np.searchsorted(-length, -np.arange(n), side="left")  # how many reads have a base at each place
    hit, miss = np.log(match), np.log((1 - match) / 3)
    opened, extended, on, free = np.log(gap_open), np.log(gap_extend), np.log(1 - 2 * gap_open), np.log(0.25)
    m, ins = np.full((b, nm), -np.inf), np.full((b, nm), -np.inf)
    m[:, 0] = np.where(unit[:, 0] == base[0], hit, miss)
    back_m, back_i = np.zeros((n, b, nm), dtype=np.int8), np.zeros((n, b, nm), dtype=bool)
    score, state, kind = np.zeros(b), np.zeros(b, dtype=np.int64), np.zeros(b, dtype=bool)
    for i in range(n):
        a = active[i]
        if i:
            before_m, before_i = np.roll(m, 1, axis=1) + on, np.roll(ins, 1, axis=1) + on
            at, best = (before_i > before_m).astype(np.int8), np.maximum(before_m, before_i)
            if nm > 1:
                for code, table in ((2, m), (3, ins)):
                    skipped = np.roll(table, 2, axis=1) + opened
                    at[skipped > best] = code
                    best = np.maximum(best, skipped)
            new, longer = m + opened, ins + extended
            back_m[i, :a], back_i[i, :a] = at, longer > new
            m, ins = best + np.where(unit[:a] == base[i, :a, None], hit, miss), np.maximum(new, longer) + free
        goes_on = active[i + 1] if i + 1 < n else 0
        if goes_on < a:
            ended = slice(goes_on, a)
            both = np.maximum(m[ended], ins[ended])
            state[ended] = both.argmax(axis=1)
            rows = np.arange(a - goes_on)
            score[ended], kind[ended] = both[rows, state[ended]], ins[ended][rows, state[ended]] > m[ended][rows, state[ended]]
            m, ins = m[:goes_on], ins[:goes_on]
    states, kinds = np.zeros((n, b), dtype=np.int64), np.zeros((n, b), dtype=bool)
    for i in range(n - 1, -1, -1):
        a = active[i]
        s, k, rows = state[:a], kind[:a], np.arange(a)
        states[i, :a], kinds[i, :a] = s, k
        if i:
            at = back_m[i, rows, s]
            state[:a], kind[:a] = (s - np.where(k, 0, 1 + (at >> 1))) % nm, np.where(k, back_i[i, rows, s], (at & 1) > 0)
    copies, perfect, run, good = np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.int64), np.ones(b, dtype=bool)
    for i in range(n):
        a = active[i]
        s, k = states[i, :a], kinds[i, :a]
        first = (s == 0) & ~k
        run[:a] = np.where(first, 0, run[:a]) + 1
        good[:a] = (good[:a] | first) & ~k & (base[i, :a] == unit[np.arange(a), s])
        copies[:a] += first
        perfect[:a] += good[:a] & (s == nm - 1) & (run[:a] == nm)
    return list(zip(copies.tolist(), perfect.tolist(), score.tolist()))


def detect_motifs(seq: str, most: int = 10, longest: int = 10) -> list[tuple[str, float, int]]:
    """(canonical motif, share of bases equal to those a motif before, copies of it) of the best motifs of a tract.

    Motifs of every length are the most frequent k-mers; repeats of a shorter motif don't count. The best have the
    largest share, shorter ones first among equals.
    """
    seq = seq.upper()
    found: dict[str, tuple[float, int]] = {}
    for k in range(1, min(longest, len(seq) // 2) + 1):
        share = sum(a == b for a, b in zip(seq, seq[k:])) / (len(seq) - k)
        words = Counter(seq[i : i + k] for i in range(len(seq) - k + 1))
        for w, n in words.most_common(2):
            if "N" in w or any(k % d == 0 and w == w[:d] * (k // d) for d in range(1, k)):
                continue
            c = min(w[i:] + w[:i] for i in range(k))
            if c not in found or found[c][0] < share:
                found[c] = (round(share, 4), n)
    return sorted(((c, s, n) for c, (s, n) in found.items()), key=lambda x: (-x[1], len(x[0]), x[0]))[:most]


def repeat_region(before: str, indel: str, after: str) -> tuple[int, int]:
    """How far an indel's sequence can be moved to the left and to the right of its place without a change of the result."""
    s, left = indel, 0
    while left < len(before) and s and before[len(before) - 1 - left] == s[-1]:
        s = s[-1] + s[:-1]
        left += 1
    s, right = indel, 0
    while right < len(after) and s and after[right] == s[0]:
        s = s[1:] + s[0]
        right += 1
    return left, right
