"""Random records for brute-force comparison."""


def random_records(rng, n):
    rows = []
    for d in range(n):
        text = "".join(rng.choice("abc é😀") for _ in range(rng.randint(0, 40)))
        entities, at = [], 0
        while at < len(text):
            at += rng.randint(0, 5)
            size = rng.randint(1, 6)
            if at + size > len(text):
                break
            entities.append((rng.choice(["ORG", "NAME", "GEO"]), at, at + size))
            at += size
        rows.append((f"d{d}", text, entities))
    return rows
