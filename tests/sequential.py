"""Plain-Python statement of the grouping rule, for small inputs only."""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b, w):
    """``a`` and ``b`` are normal names."""
    ta, tb = set(a.split()), set(b.split())
    union = len(ta | tb)
    j = len(ta & tb) / union if union else 0
    lev = 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0
    return w * j + (1 - w) * lev


def lead(vertices, compatible):
    """``vertices`` in order → index of the leader of each."""
    leaders, owner = [], []
    for i, v in enumerate(vertices):
        hit = next((k for k in leaders if compatible(vertices[k], v)), None)
        owner.append(i if hit is None else hit)
        if hit is None:
            leaders.append(i)
    return owner
