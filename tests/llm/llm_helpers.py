"""Made-up texts."""


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, ws, share):
    """A copy with about so many words replaced."""
    return [f"c{rng.randrange(10**6)}" if rng.random() < share else w for w in ws]
