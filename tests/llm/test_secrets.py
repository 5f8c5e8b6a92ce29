import random

from scenefold.llm import secrets


def corpus():
    rng = random.Random(6)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    plain = ["the", "station", "representation", "internationalisation", "questionable", "under", "with", "words"]
    rows, planted = [], {}
    for i in range(400):
        text = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            planted[i] = token()
            text.insert(9, f'token = "{planted[i]}"')
        if i % 5 == 0:
            text.insert(3, str(rng.randrange(10**15, 10**16)))
        if i % 7 == 0:
            text.insert(20, "/usr/local/share/questionable/words")
        rows.append((i, " ".join(text)))
    return rows, planted


def test_held_out_secrets_are_found_and_plain_words_are_not(documents):
    rows, planted = corpus()
    extra = [(900, None), (901, ""), (902, "x" * 50_000), (903, "été" + "a" * 20), (904, "a" * 20 + "é"), (1, rows[1][1])]
    found = secrets.scan(documents(rows + extra), None).collect()
    said = {r.doc_id: r.candidate for r in found if r.is_secret}
    assert said == planted
    assert {r.doc_id for r in found} >= {902} and not {r.doc_id for r in found} & {900, 901, 903, 904}
    assert all(r.length == len(r.candidate) and 0 <= r.probability <= 1 for r in found)
    report = secrets.secret_report(documents(rows))
    kept = [r for r in report.collect() if r.is_secret]
    assert len(kept) == len(planted)
    assert "PythonUDF" not in report._jdf.queryExecution().toString()


def test_candidates_stand_in_text_order(documents):
    text = "k" * 16 + " then /a/very/long/path/name and 0123456789abcdef0123."
    got = secrets.candidates(documents([(1, text)])).orderBy("place").collect()
    assert [r.candidate for r in got] == ["k" * 16, "/a/very/long/path/name", "0123456789abcdef0123"]
    assert got[1].before.endswith("then ") and got[2].after == "."


def test_tables_with_one_kind_of_finding(documents):
    assert secrets.scan(documents([])).count() == 0
    only = secrets.scan(documents([(1, "plain " + "questionable" * 3)])).collect()
    assert [r.is_secret for r in only] == [False]
