"""Matching by shared words against brute force."""

from difflib import SequenceMatcher

from annalum.operators import resolve


def test_reconcile_with_frequent_and_short_words(spark):
    """A word in over 500 titles, words of three letters, titles without a match or words."""
    b = [(i, f"battle of x{i % 7} y{i % 90}", i % 50) for i in range(600)] + [(600, "red sea", 5), (601, "ur", 1)]
    a = [(0, "Battle, y3", 3), (1, "battle x2 y89", None), (2, "The RED one", 5), (3, "nothing", 5), (4, "ur", 1), (5, None, 1), (6, "battle zz", 12)]
    words = lambda s: {w for w in s.split() if len(w) >= 3}
    expected = {}
    for i, title, year in a:
        s, found = (title or "").lower().replace(",", ""), []
        for j, other, y in b:
            if words(s) & words(other):
                near = 0 if year is None else max(0, 100 - 10 * abs(year - y))
                found.append((round(80 * SequenceMatcher(None, s, other).ratio() + 0.2 * near, 6), -j))
        score, j = max(found) if found else (0.0, None)
        expected[i] = (None if j is None else -j, score, "AUTO" if score >= 85 else "REVIEW" if score >= 60 else "NONE")
    got = resolve.fuzzy_reconcile(spark.createDataFrame(a, "id long, title string, year int"), spark.createDataFrame(b, "id long, title string, year int")).collect()
    assert {r.a_id: (r.b_id, round(r.score, 6), r.decision) for r in got} == expected and len(got) == len(a)


def test_best_person_across_borders_and_nulls(spark):
    people = [(1, "Gaius Marius", 199, 250), (2, "Gaius Marius", 201, 252), (3, "Gaius Mario", 203, None), (4, "Livia Drusa", None, None), (5, "livia drusa", None, 14), (6, "Livia Drus", -58, 29), (7, "Livia Drusos", -58, 29), (8, "Solon", 0, 60), (9, "Gaius Marius", 900, 950), (10, "ab", 1, 2), (11, None, 1, 2)]
    words = lambda s: {w for w in s.lower().split() if len(w) >= 3}

    def life(p, q):
        total = 0
        for c in (2, 3):
            if p[c] is not None and q[c] is not None:
                gap = abs(p[c] - q[c])
                if gap > 10:
                    return 0
                total += 40 if gap == 0 else 30 if gap <= 2 else 20 if gap <= 5 else 10
        return total

    expected = {}
    for p in people:
        best = None
        for q in people:
            if p[0] == q[0] or p[1] is None or q[1] is None or not words(p[1]) & words(q[1]):
                continue
            x, y = p[1].lower(), q[1].lower()
            name = 100 if x == y else 90 if x in y or y in x else 100 * SequenceMatcher(None, x, y).ratio()
            if name >= 50:
                years = life(p, q)
                kind = "name_only" if years < 20 else "exact" if name >= 95 else "fuzzy" if name >= 80 else "lifespan"
                best = max(filter(None, (best, (round(0.6 * name + years, 6), -q[0], kind))))
        expected[p[0]] = (-best[1], best[0], best[2]) if best and best[0] >= 70 else (None, best[0] if best else 0.0, "new")
    assert expected[1] == (2, 120.0, "exact")
    df = spark.createDataFrame(people, "id long, name string, birth_year int, death_year int")
    assert {r.a_id: (r.b_id, round(r.score, 6), r.kind) for r in resolve.best_person_match(df, df).collect()} == expected
