"""Plain versions of the operators, for small tables."""

import hashlib


def remove_repeats(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by comparing every window with every owner."""
    big = (1 << 63) - 1
    rows = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    owner: dict[bytes, int] = {}
    for i, t in rows:
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if owner[t[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        rest = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if i == big else i, len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def shingles(text: str | None, words: int = 5) -> set:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x.decode() for x in (text or "").translate(lower).encode().split()]
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def jaccard_components(rows: list[tuple[int | None, str | None]], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing every pair."""
    big = (1 << 63) - 1
    sets = [(big if i is None else i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    root[find(a)] = find(b)
    least: dict[int, int] = {}
    for a, (i, s) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), big), i)
    real = lambda x: None if x == big else x
    return [(real(i), len(s), real(least[find(a)])) for a, (i, s) in enumerate(sets)]


def viterbi(model, new: list[int], marker: list[int], size: list[int], asks: list[int]) -> list[int]:
    """The best roles of one run of lines; of equal ways the one that, looking back from the end, first meets a lesser role."""
    roles = range(len(model.first))
    emit = [[model.mark[n][r][m] + model.size[r][s] + model.asks[r][a] for r in roles] for n, m, s, a in zip(new, marker, size, asks)]
    score, back = [model.first[r] + emit[0][r] for r in roles], []
    for t in range(1, len(emit)):
        ways = [[score[i] + model.move[new[t]][i][j] for i in roles] for j in roles]
        back.append([w.index(max(w)) for w in ways])
        score = [max(w) + emit[t][j] for j, w in enumerate(ways)]
    path = [score.index(max(score))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def mixture(counts: dict[int, int], logs: list[list[float]], steps: int, overlap: int) -> list[float]:
    """Shares of languages by expectation-maximisation, languages left out while that costs less than the penalty saved."""
    import math

    total = sum(counts.values())
    penalty = 0.5 * math.log(max(total, 2)) * overlap
    top = {g: max(row[g] for row in logs) for g in counts}

    def fit(who: list[int], w: list[float]) -> tuple[list[float], float]:
        p = {g: [math.exp(logs[i][g] - top[g]) for i in who] for g in counts}
        mean = lambda g: sum(a * b for a, b in zip(w, p[g]))
        for _ in range(steps):
            w = [w[k] * sum(c * p[g][k] / mean(g) for g, c in counts.items()) / total for k in range(len(who))]
        return w, sum(c * math.log(mean(g)) for g, c in counts.items())

    who = list(range(len(logs)))
    w, fitted = fit(who, [1 / len(who)] * len(who))
    while len(who) > 1:
        least = w.index(min(w))
        rest = [x for k, x in enumerate(w) if k != least]
        w2, fitted2 = fit(who[:least] + who[least + 1 :], [x / sum(rest) for x in rest])
        if fitted - fitted2 > penalty:
            break
        who, w, fitted = who[:least] + who[least + 1 :], w2, fitted2
    shares = [0.0] * len(logs)
    for i, x in zip(who, w):
        shares[i] = x
    return shares


def row_numbers(rows: list[tuple]) -> list[int]:
    """The number of each row (id, text) in the order of an MD5, nulls first."""
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    key = lambda r: (md5(f"{'-' if r[0] is None else r[0]}:{md5(r[1] or '')}"), r[0] is not None, r[0])
    order = sorted(range(len(rows)), key=lambda i: key(rows[i]))
    out = [0] * len(rows)
    for n, i in enumerate(order):
        out[i] = n
    return out


def poisson_copies(key: str, rate: float, seed: int) -> int:
    """Copies of a document by inversion at a uniform number from an MD5, in as many draws as the mean asks for."""
    import hashlib
    import math

    draws, n = math.ceil(rate / 32.0), 0
    for draw in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{key}:{draw}".encode()).hexdigest()[:13], 16) / 2**52
        m = rate / draws
        k, p = 0, math.exp(-m)
        cdf = p
        while u >= cdf:
            k += 1
            p *= m / k
            cdf += p
        n += k
    return n
