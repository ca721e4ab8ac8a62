"""Cases that an operator once left out, each on a few rows."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def saved(spark, path, rows, schema="doc_id long, text string", files=2):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_pipeline_removes_short_repeated_lines(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "Menu\nRead more\n\nall of this line is new"), (2, "menu\n\nonly here\nREAD  more\n  \nread more now"), (3, "only here\nMenu")]
    got = corpus_pipeline.line_dedup(spark, saved(spark, tmp_path / "d", rows), "")
    assert {tuple(r) for r in got.collect()} == {rows[0], (2, "\nonly here\n  \nread more now")}


def test_wrapped_license_notices(spark, tmp_path):
    from tilequarry.llm import licenses

    filler = " ".join(f"word{k}" for k in range(200))
    wrapped = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    cases = [(label, t) for label, texts in licenses.TEMPLATES.items() for t in texts if len(t.split()) > 12]
    assert {"mit", "apache", "gpl", "bsd", "mpl"} <= {label for label, _ in cases}
    rows = [(k, filler + "\n# " + wrapped(t, 9) + "\n\n" + filler) for k, (_, t) in enumerate(cases)] + [(99, filler + "\n" + filler)]
    got = {r["doc_id"]: r for r in licenses.scan(saved(spark, tmp_path / "d", rows)).collect()}
    assert all(label in got[k]["labels"].split(",") and got[k]["score"] == 1.0 for k, (label, _) in enumerate(cases))
    assert got[99]["labels"] == "" and got[99]["score"] == 0.0


def test_secrets_within_longer_runs(spark, tmp_path):
    from tilequarry.llm import secrets

    r = random.Random(5)
    key = lambda alphabet=BASE62, n=40: "".join(r.choice(alphabet) for _ in range(n))
    forms = ["SESSION_KEY={}", "AWS_ACCESS={} end", "https://x.org/get?id=7&sig={}&v=2", "see /srv/keys/my-app/{}", "é A_B={}= x=y", "{}"]
    keys = [(k, f, key(BASE62[:52], 24) if f == "{}" else key()) for k, f in enumerate(forms * 20)]
    rows = [(k, f.format(x)) for k, f, x in keys] + [(k, "some_name=" + "other" * 8 + "=-/_" + "ab1" * 10) for k in range(200, 260)]
    got = {row["doc_id"]: [rows[row["doc_id"]][1][x["start"] : x["stop"]] for x in row["spans"] if x["kind"] == "random"] for row in secrets.scan(saved(spark, tmp_path / "d", rows)).collect() if row["doc_id"] < 200}
    for f in forms:
        assert sum(any(x in y for y in got[k]) for k, g, x in keys if g == f) >= 16, f


def test_empty_and_unclosed_elements_take_no_text_with_them():
    from tilequarry.llm import html

    told = lambda page: [b.text for b in html.blocks(page)]
    assert told('<article><p>One <svg class="i"/> two.</p><p>Three.</p></article><svg>x</svg>') == ["One two.", "Three."]
    assert told("<p>One <object data='a'/> two.</p><p>Three</p>") == ["One two.", "Three"]
    for tag in ("noscript", "template", "title", "svg", "iframe", "object"):
        assert told(f"<p>One</p><{tag} a=b><p>two</p><p>three</p><{tag}>four") == ["One", "two", "three", "four"]
        assert told(f"<p>One</p><{tag}><p>two</p></{tag}><p>three</p>") == ["One", "three"]
    assert told("<p>One <svg src=a/><b>no</b></svg> two</p>") == ["One two"]
    assert told("<p>One</p><script>two") == told("<p>One</p><style>two") == ["One"]


def test_row_numbers_do_not_depend_on_how_a_scan_is_split(spark, tmp_path):
    """Each job of a call plans its scan anew, with other cores and another size of partitions: the rows are the same."""
    from tilequarry.llm import jaccard, leaks, lines, store, substrings

    r = random.Random(9)
    line = lambda n=12: " ".join(r.choice(BASE62) * r.randint(1, 9) for _ in range(n))
    shared, item = line(30), line(20)
    rows = [(k, "\n".join([line(), shared, line(), item if k % 7 == 0 else line()])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(20)]
    docs = saved(spark, tmp_path / "d", rows, files=9)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    calls = {
        "lines": lambda: lines.without_later_lines(docs), "substrings": lambda: substrings.without_repeats(docs), "components": lambda: jaccard.near_duplicates(docs).drop("uid"),
        "first": lambda: jaccard.keep_first(docs), "clean": lambda: leaks.decontaminate(docs, bench),
    }
    cores, size = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes"
    old, plain, turn = spark.conf.get(size), store.written, [0]

    def other(*a, **k):
        out = plain(*a, **k)
        turn[0] += 1
        spark.conf.set(cores, (1, 16, 3)[turn[0] % 3])
        spark.conf.set(size, ("100000000", "2000", "9000")[turn[0] % 3])
        return out

    for name, call in calls.items():
        want = sorted(map(repr, call().collect()))
        try:
            store.written = other
            got = call()
            spark.conf.set(cores, 2)
            spark.conf.set(size, "4000")
            assert sorted(map(repr, got.collect())) == want and turn[0], name
        finally:
            store.written = plain
            spark.conf.unset(cores)
            spark.conf.set(size, old)


def test_html_extraction_of_a_table(spark, tmp_path):
    import pandas as pd

    from tilequarry.llm import html

    r = random.Random(4321)
    made = [html.labelled_page(r) for _ in range(120)]
    pages = [(i, f"u{i}", p) for i, (p, _) in enumerate(made)]
    odd = [(900, None, None), (None, "u", ""), (901, "u", "<nav>only a menu</nav>"), (5, "u5", made[5][0]), (902, "long", "<article>" + "<p>One sentence of an article, and it is not short.</p>" * 20_000 + "</article>")]
    # Extra columns, one of them named as a result is.
    rows = [(*p, "x", 7) for p in pages + odd]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3).write.parquet(path)
    got = html.op1_html_extraction(spark, str(tmp_path)).toPandas()
    assert got.columns.tolist() == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    assert (got["text"].map(len) == got["n_chars"]).all()
    chain = html.trained()
    want = pd.DataFrame([(i, u, html.main_text(h, chain)) for i, u, h in pages + odd], columns=["page_id", "url", "text"])
    keyed = lambda df: sorted((str(a), str(b), c) for a, b, c in df[["page_id", "url", "text"]].astype({"page_id": "Int64"}).itertuples(index=False))
    assert keyed(got) == keyed(want)
    by_id = dict(zip(got["page_id"], got["text"]))
    assert by_id[900] == by_id[901] == "" and by_id[902].count("\n") == 19_999
    assert (got["page_id"] == 5).sum() == 2 and got[got["page_id"] == 5]["text"].nunique() == 1
    # Held-out pages of known articles: most texts are right to the letter.
    right = sum(by_id[i] == "\n".join(" ".join(m.split()) for m in main if m.split()) for i, (_, main) in enumerate(made))
    assert right >= 0.7 * len(made), right
    none = html.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.collect() == [] and none.columns == got.columns.tolist()


def test_dedup_holds_little_of_the_rarity_table_on_the_driver(spark, tmp_path):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tilequarry.llm import jaccard
    from tilequarry.llm.words import SPACE, find_words

    texts = [" ".join(f"w{k % m}" for k in range(60)) for m in range(1, 40)] + ["", "one two"]
    rows = jaccard.rows_of(saved(spark, tmp_path / "d", list(enumerate(texts))))
    counts = np.zeros(1 << jaccard.BITS, np.int64)
    for w in find_words(pa.array(texts), SPACE, lower=True):
        np.add.at(counts, (w.shingles(jaccard.N)[0] >> np.uint64(64 - jaccard.BITS)).astype(np.int64), 1)
    tracemalloc.start()
    try:
        _, rarity = jaccard.survey(rows)
        jaccard.index_lists(rows, rarity, jaccard.Threshold())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rarity.dtype == np.uint8 and (rarity == np.floor(4 * np.log2(counts + 1.0))).all() and rarity.any()
    assert peak < 6 * rarity.nbytes, peak  # as whole counts, the table alone is eight times that
