"""Plain versions of operators, shared by tests."""

import hashlib

from test_simhash import slow_fingerprint, union


def plain_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = union(range(len(fps)), pairs)
    return [root[i] for i in range(len(rows))]


def hash_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:12], 16)


def plain_times(rows):
    """How often each (doc_id, text, source) is taken: rounds of resharing, then the nearest prefix in hash order."""
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    size = {}
    for (_, _, s), n in zip(rows, sizes):
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    out = [0] * len(rows)
    for source in order:
        groups = {}
        for i, (doc_id, _, s) in enumerate(rows):
            if s == source:
                groups.setdefault(hash_of(doc_id), []).append(i)
        whole = int(target[source] > size[source])
        budget, run, inside = target[source] - whole * size[source], 0, True
        for h in sorted(groups):
            here = sum(sizes[i] for i in groups[h])
            take = inside
            if inside and run + here > budget:
                inside, take = False, (budget - run) * 2 > here
            run += here
            for i in groups[h]:
                out[i] = whole + take
    return out
