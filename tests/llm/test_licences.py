import re
import textwrap

from tallyspark.llm.licences import NOTICES, TEXTS, licence_matches, licence_passages, notices, passage_templates


def grams(text):
    w = re.findall("[a-z0-9]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return set(zip(w, w[1:]))


def brute(rows):
    out = []
    for i, text in rows:
        parts = [] if text is None else [text, *(text.split("\n") if "\n" in text else [])]
        for s, part in enumerate(parts):
            a, best = grams(part), None
            for k, (name, t) in enumerate(NOTICES):
                b = grams(t)
                n = len(a & b)
                if a and 200 * n >= 80 * (len(a) + len(b)) and (best is None or n / (len(a) + len(b)) > best[0]):
                    best = (n / (len(a) + len(b)), (i, s, name, k, n, len(a), len(b)))
            if best:
                out.append(best[1])
    return sorted(out, key=str)


def test_equals_brute_force_and_odd_rows(spark):
    apache, mit = NOTICES[1][1], NOTICES[14][1]
    rows = [(1, mit), (2, f"Own words.\n{mit}\nand more"), (3, None), (4, ""), (5, "word " * 50000), (6, f"x\n{apache.upper()}\n\n{mit} Yes."), (None, mit), (1, mit), (7, apache.replace("License", "Licence")), (8, "licensed"), (10, "Licensed under CC\u212anc BY\u212aNC\u212a4.0."), (9, "\n".join(t for _, t in NOTICES))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, licence string")
    assert sorted((tuple(r) for r in licence_matches(df, notices(spark)).collect()), key=str) == brute(rows)
    assert licence_matches(spark.createDataFrame([], "doc_id bigint, text string"), notices(spark)).count() == 0
    assert licence_matches(df, notices(spark).where("template < 0")).count() == 0


def test_passages_are_found_wrapped_embedded_and_whole(spark):
    gpl, mit = NOTICES[12][1], TEXTS[0][1]
    wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(gpl, 60))
    rows = [(1, f"/* Own words.\n{wrapped}\n*/ {'more text here ' * 300}"), (2, f"{'before it ' * 200}{NOTICES[4][1]} and after it " + "x y z " * 200)]
    rows += [(3, f"Copyright someone\n\n{textwrap.fill(mit, 70)}\n"), (4, f"{mit}\n{mit}"), (5, None), (6, ""), (7, "of the " * 5000), (None, gpl), (8, gpl), (8, gpl)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.first_word, r.licence, r.template) for r in licence_passages(df, passage_templates(spark)).collect()), key=str)
    n, whole = len(re.findall("[A-Za-z0-9]+", mit)), len(NOTICES)
    want = [(1, 2, "GPL-3.0-or-later", 12), (2, 400, "CC-BY-4.0", 4), (3, 2, "MIT", whole), (4, 0, "MIT", whole), (4, n, "MIT", whole), (None, 0, "GPL-3.0-or-later", 12), (8, 0, "GPL-3.0-or-later", 12), (8, 0, "GPL-3.0-or-later", 12)]
    assert got == sorted(want, key=str)
    assert licence_passages(df.where("doc_id = 99"), passage_templates(spark)).count() == 0
    assert licence_passages(df, passage_templates(spark).where("template < 0")).count() == 0
