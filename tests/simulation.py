"""A plain queue over Python lists, for comparison."""

from collections import deque


def slice_of(items):
    k = max(1, len(items) // 20)
    start = len(items) // 2 - k // 2
    return items[start : start + k]


def simulate(n, g=0):
    """(permutation, nodes): nodes is {heap number: (level, kind, n_in, sep, a, b)}."""
    own, nodes = {}, {}
    queue = deque([(1, 0, list(range(n)), 0, g)])
    while queue:
        node, level, items, sx, w = queue.popleft()
        if len(items) <= 128:
            own[node], nodes[node] = items, (level, "leaf", len(items), len(items), 0, 0)
            continue
        kind, sep = "spectral", slice_of(items)
        if g and w > 8 and g > 8:
            cross = [v for v in items if sx <= v % g < sx + w and v // g < g and (v % g - sx == w // 2 or v // g == g // 2)]
            kind, sep = ("geometric", cross) if cross else ("geo_fallback", sep)
        gone = set(sep)
        rest = [v for v in items if v not in gone]
        a, b = rest[0::2], rest[1::2]
        own[node], nodes[node] = sep, (level, kind, len(items), len(sep), len(a), len(b))
        queue.append((2 * node, level + 1, a, sx, w // 2))
        queue.append((2 * node + 1, level + 1, b, sx + w // 2, w // 2))
    out, stack = [], [(1, False)]
    while stack:
        node, seen = stack.pop()
        if node not in own:
            continue
        if seen:
            out.extend(own[node])
        else:
            stack += [(node, True), (2 * node + 1, False), (2 * node, False)]
    return out, nodes
