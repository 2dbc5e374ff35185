"""The defining one-by-one rules, in plain Python, to compare Spark with."""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    return 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b))


def grow_and_assign(proposals, existing, theta, cap, high_water):
    """``proposals``: sorted (id, idx, name); ``existing``: {id: name}."""
    tags, new, given = dict(existing), [], []
    for sid, idx, name in proposals:
        scored = [(-similarity(name.lower(), t.lower()), i) for i, t in tags.items()]
        scored = [s for s in scored if -s[0] >= theta]
        if scored:
            given.append((sid, idx, min(scored)[1], False))
        elif len(tags) < cap:
            high_water += 1
            tags[high_water] = name
            new.append((high_water, name, sid, idx))
            given.append((sid, idx, high_water, True))
    return new, given


def merge_arrays(lists, pairs, groups):
    """Arrays after merging group by group; ``groups``: [(primary, [merged])]."""
    lists = {k: None if v is None else list(v) for k, v in lists.items()}
    pairs = set(pairs)
    for primary, merged in groups:
        for tag in merged:
            for sid in [s for s, t in sorted(pairs) if t == tag]:
                pairs.discard((sid, tag))
                pairs.add((sid, primary))
                if lists.get(sid) is not None:
                    had = primary in lists[sid]
                    rest = [t for t in lists[sid] if t != tag]
                    lists[sid] = rest if had else rest + [primary]
    return lists, pairs
