import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.lines import common_lines, drop_aligned_lines, patience


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=20), st.lists(st.integers(0, 9), max_size=20))
def test_alignment_rises_and_matches(a, b):
    p = patience(a, b)
    assert all(a[i] == b[j] for i, j in p)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    if a == b:
        assert len(p) == len(a)


def brute(rows, rare=64):
    """Straight from the definition, with its own recursive alignment."""

    def align(a, b, i, j):
        if not a or not b:
            return []
        if a[0] == b[0]:
            return [(i, j), *align(a[1:], b[1:], i + 1, j + 1)]
        if a[-1] == b[-1]:
            return [*align(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
        once = [(a.index(x), b.index(x)) for x in a if x and a.count(x) == 1 and b.count(x) == 1]
        size = []
        for k, p in enumerate(once):
            size.append(1 + max((size[m] for m in range(k) if once[m][1] < p[1]), default=0))
        run, k, n = [], len(once), max(size, default=0)
        while n:  # of the longest runs, the one whose ends are the smallest
            k = min((m for m in range(k) if size[m] == n), key=lambda m: once[m][1])
            run.insert(0, once[k])
            n -= 1
        out, x, y = [], 0, 0
        for p, q in run:
            out += [*align(a[x:p], b[y:q], i + x, j + y), (i + p, j + q)]
            x, y = p + 1, q + 1
        return out + (align(a[x:], b[y:], i + x, j + y) if run else [])

    lines = {i: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")] for i, t in rows}
    holders = {}
    for i, ls in lines.items():
        for x in set(ls):
            if len(x) >= 20:
                holders.setdefault(x, []).append(i)
    out = {}
    for i, ls in lines.items():
        partners = {}
        for x in set(ls):
            if x in holders and min(holders[x]) < i:
                partners.setdefault(min(holders[x]), []).append(x)
        gone = set()
        for j, shared in partners.items():
            few = {x for x in shared if len(holders[x]) <= rare}
            if len(shared) < 2 and not few:
                continue
            run = []
            for p in [*align(lines[j], ls, 0, 0), None]:
                if run and (p is None or p != (run[-1][0] + 1, run[-1][1] + 1)):
                    long = [ls[y] for _, y in run if len(ls[y]) >= 20]
                    if len(long) > 1 or any(x in few for x in long):
                        gone |= {y for _, y in run}
                    run = []
                run.append(p)
        out[i] = ("\n".join(x for k, x in enumerate(dict(rows)[i].split("\n")) if k not in gone), len(gone))
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    pool = [f"{'line' if k % 3 else 'a longer line with words'} {k}" for k in range(80)]
    rows = []
    for i in range(150):
        text = [r.choice(["", *pool]) if r.random() < 0.3 else f"own line of document {i}, number {k}" for k in range(r.randrange(1, 12))]
        if rows and r.random() < 0.5:
            other = r.choice(rows)[1].split("\n")
            cut = r.randrange(len(other))
            text[len(text) // 2 : len(text) // 2] = other[cut : cut + 5]
        rows.append((i * 13 % 997, "\n".join(text)))
    for rare in (2, 64):
        got = {x.doc_id: (x.text, x.n_dropped) for x in drop_aligned_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), rare=rare).collect()}
        assert got == brute(rows, rare)


def test_odd_rows(spark):
    a = "a first line that is long enough\nand a second one that is long too"
    rows = [(1, None, 0), (2, "", 0), (3, a, 0), (3, a, 0), (4, f"own words here\n{a}\n", 0), (None, a, 0), (5, "x\n" * 9000, 0), (3, f"{a}\nend", 0)]
    got = sorted(((x.doc_id, x.text, x.n_dropped) for x in drop_aligned_lines(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int"), keep=("doc_id",)).collect()), key=str)
    assert (1, None, 0) in got and (2, "", 0) in got and (None, a, 0) in got and (4, "own words here\n", 2) in got and (5, "x\n" * 9000, 0) in got
    assert sorted(x[2] for x in got if x[0] == 3) in ([0, 0, 2], [0, 2, 2])
    assert drop_aligned_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_line_of_many_documents_goes_from_all_but_the_first(spark):
    line = "a passage of one line that very many documents share"
    rows = [(i, f"own words of document {i} come first\n{line}\nand document {i} ends like this") for i in range(70)]
    got = {x.doc_id: x.text for x in drop_aligned_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if i == 0 or x != line) for i, t in rows}
    # Shared lines that alternate with lines of a document's own.
    rows = [(i, "\n".join(x for k in range(3) for x in (f"the shared line of number {k}", f"line {k} as document {i} has it"))) for i in range(70)]
    got = {x.doc_id: x.n_dropped for x in drop_aligned_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 3 * (i > 0) for i in range(70)}


def test_a_block_whose_lines_have_other_first_holders_goes(spark):
    x, y = "the first line of a block that many share", "the second line of a block that many share"
    rows = [(0, f"{x}\nonly the oldest document goes on like this")] + [(i, f"own words of document {i} here\n{x}\n{y}\nthe end of document {i} as it is") for i in range(1, 101)]
    got = {d.doc_id: d.n_dropped for d in drop_aligned_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: min(i, 2) for i in range(101)}


def test_recall_against_all_overlapping_pairs(spark):
    """Of the lines that go when every pair of documents with a common long line is aligned, first holders find nearly all."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    numbers = {}

    def code(line):
        line = line.strip(" \t\r\x0b\x0c")
        return 2 * numbers.setdefault(line, len(numbers) + 1) + (len(line) >= 20) if line else 0

    docs = [[code(x) for x in text.split("\n")] for _, text in rows]
    holders = {}
    for i, doc in enumerate(docs):
        for x in {x for x in doc if x & 1}:
            holders.setdefault(x, []).append(i)
    by_first, by_all = {}, {}
    for h in holders.values():
        for k, later in enumerate(h[1:], 1):
            by_first.setdefault(later, set()).add(h[0])
            by_all.setdefault(later, set()).update(h[:k])
    gone = lambda pairs: {(j, y) for j, earlier in pairs.items() for i in earlier for y in common_lines(docs[i], docs[j], None)}
    first, all_ = gone(by_first), gone(by_all)
    got = {r.doc_id: r.n_dropped for r in drop_aligned_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: len({y for j, y in first if j == k}) for k, (i, _) in enumerate(rows)}
    assert len(first & all_) >= 0.97 * len(all_) > 0
