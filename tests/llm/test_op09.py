import pytest

from touchline.llm import op09_decontamination as op

ITEMS = [
    (1, "A train leaves Boston at 9:30 and travels 120 miles to Albany before noon. How far does the train go when Boston is left behind?"),
    (2, "plain words make up this second item of the list which has no slots at all"),
    (3, "Short item of just six"),
    (4, None),
    (5, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (6, "Sum of 40 apples and 40 pears and then 15 plums that lie on the table in the old kitchen"),
    (7, "if Ann gives Bob the ball and Bob throws it back to Ann who is it that holds the ball"),
]
PAD = "some words that lead up to it and. "


def frames(spark, docs, items=ITEMS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, h int"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")


def run(spark, docs, items=ITEMS, **k):
    return sorted((r.doc_id, r.item_id) for r in op.leaks(*frames(spark, docs, items), **k).collect())


def docs():
    q = ITEMS[0][1]
    renamed = q.replace("Boston", "Dover").replace("Albany", "Ithaca").replace("120", "77").replace("9:30", "8:15").replace("miles", "km")
    clash = renamed.replace("when Dover", "when Exeter")
    sums, names = ITEMS[5][1], ITEMS[6][1]
    return [
        (10, PAD + q + " and on it goes"),
        (11, PAD * 300 + renamed + PAD * 900),
        (12, PAD + clash),
        (13, PAD + ITEMS[1][1].upper()),
        (14, "in the middle " + ITEMS[2][1] + " words"),
        (15, " ".join(reversed(q.split()))),
        (16, None),
        (17, ""),
        (18, "A train leaves Boston at 9:30 and then stops."),
        (19, "20 21 22 23 24 25 26 27 28 29 30 31"),
        (20, q + "\n" + ITEMS[1][1]),
        (21, q),
        (21, q),
        (22, "lead in 1 2 3 4 5 6 7 8 9 10 11 12 and out"),
        (23, PAD + sums.replace("40 apples and 40", "77 apples and 77")),
        (24, PAD + sums.replace("40 apples and 40", "77 apples and 91")),
        (25, PAD + sums.replace("15", "40")),
        (26, PAD + names.replace("Ann", "Eve").replace("Bob", "Tom")),
        (27, PAD + names.replace("Ann", "Zed").replace("Bob", "Zed")),
    ]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_catches_reparameterised_items(spark, limit):
    assert run(spark, docs(), broadcast_bytes=limit) == [(10, 1), (11, 1), (13, 2), (14, 3), (20, 1), (20, 2), (21, 1), (22, 5), (23, 6), (26, 7)]


def brute_tokens(text, plain=False):
    """(form, kind) of each token, by the rules of the docstring."""
    out, ended = [], True
    raw = (text or "").split()
    for word in raw:
        bare, low, number, joint = op.parse(word)
        capital = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
        ends = word.rstrip("\"')]»”").endswith((".", "!", "?", ":", "|"))
        kind = "num" if number or joint else "name" if capital and not ended else "word"
        if bare:
            if low in op.UNITS and out and out[-1][1] == "num":
                kind = "unit"
            out.append((low, kind, joint and not number, capital))
        ended = ends
    return out


def brute_leaks(docs, items, size=op.WINDOW, least=op.MIN_LITERALS, coverage=op.COVERAGE, run=op.RUN):
    found = set()
    shape = lambda t: t[0] if t[1] == "word" else t[1] + str(t[2])
    for doc_id, text in docs:
        d = brute_tokens(text)
        for item_id, item in items:
            q = brute_tokens(item)
            own = min(size, len(q))
            if not own:
                continue
            windows = range(len(q) - own + 1)
            rich = {k for k in windows if sum(t[1] == "word" for t in q[k : k + own]) >= least}
            lines = {}
            for k in windows:
                want = q[k : k + own]
                for at in range(len(d) - own + 1):
                    have = d[at : at + own]
                    if k not in rich:
                        if [t[0] for t in have] == [t[0] for t in want]:
                            lines.setdefault(at - k, []).append((k, []))
                        continue
                    same = [shape(t) for t in have] == [shape(t) for t in want]
                    first = k == 0 and want[0][1] == "word" and want[0][3] and have[0][1] == "name" and [shape(t) for t in have[1:]] == [shape(t) for t in want[1:]]
                    if same or first:
                        lines.setdefault(at - k, []).append((k, [(a[1], a[0], b[0]) for a, b in zip(want, have, strict=True) if a[1] != "word"]))
            good = set()
            for hits in lines.values():
                pairs = {p for _, own_pairs in hits for p in own_pairs}
                if len({(k, a) for k, a, _ in pairs}) == len(pairs) == len({(k, b) for k, _, b in pairs}):
                    good |= {k for k, _ in hits}
            tokens = {i for k in good for i in range(k, k + own)}
            if good and (len(good) / len(windows) >= coverage or rich and len(good & rich) / len(rich) >= coverage or len(tokens) >= run):
                found.add((doc_id, item_id))
    return sorted(found, key=str)


def test_agrees_with_brute_force(spark):
    mixed = [(100 + i, f"{PAD}{a[1] or ''} {b[1] or ''}"[: 40 + 17 * i]) for i, (a, b) in enumerate(zip(docs(), docs()[3:], strict=False))]
    rows = docs() + mixed
    assert sorted(set(run(spark, rows)), key=str) == brute_leaks(rows, ITEMS)


def test_given_tables_agree_with_brute_force(spark):
    root = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet")
    rows, items = [(r.doc_id, r.text) for r in d.collect() if len(r.text or "") < 3000][:30], [(r.item_id, r.text) for r in b.collect()][:12]
    got = op.leaks(d.where(d.doc_id.isin([i for i, _ in rows])), b.where(b.item_id.isin([i for i, _ in items]))).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}, key=str) == brute_leaks(rows, items)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, docs(), items=[]) == []


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    d = spark.createDataFrame([(i, t, None, 1, 2) for i, t in docs()], "doc_id long, text string, l_id string, h int, L_Hash int")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = op.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [12, 15, 16, 17, 18, 19, 24, 25, 27]


def test_agrees_with_plain_search(spark):
    root = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet")
    items = {r.item_id: r.text for r in b.collect()}
    plain = sorted((r.doc_id, i) for r in d.collect() for i, t in items.items() if t in (r.text or ""))
    found = sorted((r.doc_id, r.item_id) for r in op.leaks(d, b).collect())
    assert set(plain) <= set(found) and len(found) >= len(plain) > 0
