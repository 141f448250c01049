"""Main text, quality rules, decontamination, near duplicates, tool links and the pipeline."""

import html
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import common, decontaminate, main_text, quality_rules, queries, simhash, tool_links
from panelspark.llm.common import field, map_texts, table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == []


def test_main_text_is_the_article(spark, sf):
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in queries.op2_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|br|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_main_text_without_named_parts():
    body = "This is a long paragraph of text, which &amp; goes on for a while so that it is over the threshold of a window."
    page = f"""<div><a href=x>Home</a> <a>About</a></div><div><h2>Head</h2><p>{body}</p><p>short.</p></div>
    <div class="user-comments"><p>{body}</p></div><div id=cookieNotice>{body}</div><form><p>{body}</p></form>"""
    assert main_text.main_text(page) == f"Head\n{html.unescape(body)}\nshort."
    assert main_text.main_text("<main><p>Yes.</p><aside>No</aside><script>var a='</p>'</script></main><p>out</p>") == "Yes."
    assert main_text.main_text("<p>a < b and c > d</p><p>x &lt;y&gt;&nbsp;z") == "a < b and c > d\nx <y> z"
    assert [main_text.main_text(x) for x in (None, "", "<nav>a</nav>", "plain")] == ["", "", "", "plain"]
    assert len(main_text.main_text("<a '" * 2000)) >= 0  # broken markup ends


def test_rules_on_odd_texts(odd, empty):
    names = quality_rules.order(quality_rules.measure(odd))
    assert sorted(names) == sorted(quality_rules.RULES)
    rows = {r.doc_id: r for r in quality_rules.judge(odd, names).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[6].kept and rows[3].n_words == 80_000
    assert quality_rules.keep_good(odd, names).schema == odd.schema
    assert quality_rules.keep_good(empty, quality_rules.order(quality_rules.measure(empty))).count() == 0


def test_order_puts_sharp_and_cheap_rules_first():
    assert quality_rules.order([("a", 10, 1, 1.0), ("b", 10, 5, 1.0), ("c", 10, 5, 0.1)]) == ["c", "b", "a"]


def test_wu_manber_finds_what_a_plain_search_finds():
    rnd = random.Random(0)
    for _ in range(200):
        items = [[rnd.choice("abc").encode() for _ in range(rnd.randint(1, 18))] for _ in range(4)]
        strings = defaultdict(list)
        for i, w in enumerate(items):
            for s in decontaminate.windows(b" ".join(w)):
                strings[s].append(i)
        w = [rnd.choice("abc").encode() for _ in range(rnd.randint(0, 60))] + rnd.choice(items) + [b"a"] * rnd.randint(0, 3)
        want_words, want_items = set(), set()
        for s, ids in strings.items():
            t = s.split()
            for at in range(len(w) - len(t) + 1):
                if w[at : at + len(t)] == t:
                    want_words.update(range(at, at + len(t)))
                    want_items.update(ids)
        ranges, found = decontaminate.occurrences(w, decontaminate.searches(strings.items()))
        assert {q for a, b in ranges for q in range(a, b)} == want_words and found == want_items


def test_blocks_of_test_strings_change_nothing(spark, sf, odd, empty):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole, cut = decontaminate.Strings(bench), decontaminate.Strings(bench, block=300)
    assert whole.blocks == 1 and cut.blocks > 2
    a, b = (sorted(decontaminate.find(docs, s).collect()) for s in (whole, cut))
    assert a == b
    kept = [sorted(r.doc_id for r in decontaminate.keep_clean(docs, s).collect()) for s in (whole, cut)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
    rows = {r.doc_id: r for r in decontaminate.find(odd, whole).collect()}
    assert rows[1].n_words == 0 and rows[2].hits == [] and rows[3].n_words == 80_000
    for s in (whole, cut):
        assert decontaminate.keep_clean(empty, s).count() == 0 and decontaminate.find(empty, s).count() == 0
        assert decontaminate.keep_clean(odd, s).schema == odd.schema
    assert decontaminate.find(odd, decontaminate.Strings(bench.where("1 = 0"))).where("size(hits) > 0").count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fps):
    """The lowest index that each fingerprint reaches."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_groups(fps)
    want = {(d, f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, roots, strict=True)}
    assert {tuple(r) for r in queries.op7_simhash(spark, sf).collect()} == want


@pytest.mark.parametrize("bucket", [1024, 150])
def test_large_buckets_are_cut_without_losing_links(spark, bucket):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    loose = [0, 5, 9, 17, 18, 20, 33, 34, 40, 50, 51, 60, 61, 63]
    fps = {centre ^ sum(1 << int(k) for k in rng.choice(loose, rng.integers(0, 9), replace=False)) for _ in range(400)}
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 100)} | {0, 1, 7, 15}
    fps = sorted(fps)
    roots = plain_groups(fps)
    want = {(f, r) for f, r in zip(fps, roots, strict=True)}
    rows = [(i, simhash.signed(f), 1) for i, f in enumerate(fps)]
    out = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long, x int").repartition(4), bucket=bucket)
    assert {(r.fp % (1 << 64), r.component_id) for r in out.collect()} == want


def test_one_row_of_each_group_stays(odd, empty):
    kept = simhash.keep_one(odd)
    # null, empty and white space alone are one group; the repeated row leaves one; its upper-case copy goes with it
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6] and kept.schema == odd.schema
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}


def test_kept_rows_against_brute_force_jaccard(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for size in (12, 30, 100, 400):
        for _ in range(6):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            texts.append(base)
            for _ in range(5):  # copies of copies with some words changed, similarity about 0.6 to 1
                base = list(base)
                for _ in range(rnd.randint(0, max(1, size // 50))):
                    base[rnd.randrange(size)] = rnd.choice(vocabulary)
                texts.append(base)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root, only_similar = list(range(len(sets))), 0
    for j in range(len(sets)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                only_similar += sets[i] != sets[j]
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert only_similar > 20 and len(set(root)) > 24
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(root)


def test_tool_links(spark):
    calls = spark.createDataFrame(
        [
            ("a", "c", 1, "answer", {"question": 'x"\n', "turn": "7"}, None, 1),
            ("b", "c", 2, "answer", {"turn": "x", "more": "1"}, "a", 1),
            ("d", "c", 3, "other", {}, "b", 1),
            ("e", "c", 4, "answer", {"question": "", "turn": "01"}, "f", 1),
            ("f", "c", 5, "answer", {"question": None, "turn": "-1"}, "e", 1),
            (None, "c", 6, "answer", {"question": "q", "turn": "1"}, None, 1),
        ],
        "call_id string, conv_id string, call_turn long, name string, arguments map<string,string>, waits_for string, call_copies long",
    )
    results = spark.createDataFrame([("a", "c", 2, "done", 1), ("z", "c", 9, None, 2)], "call_id string, result_conv string, result_turn long, result string, result_copies long")
    rows = {r.call_id: r for r in tool_links.link(calls, results, tool_links.answer_schema(spark)).collect()}
    assert rows["a"].json == '{"arguments":{"question":"x\\"\\n","turn":7},"id":"a","name":"answer","result":"done"}'
    assert [rows[k].status for k in ("a", "b", "z", None)] == ["answered", "unanswered", "orphan", "no_id"]
    assert [rows[k].depth for k in ("a", "b", "d", "e", "f")] == [0, 1, 2, None, None]
    assert rows["b"].errors == "more: unknown; question: missing; turn: kind" and not rows["b"].valid
    assert rows["d"].errors == "unknown function" and rows["e"].errors == "question: range; turn: kind"
    assert rows["f"].errors == "question: missing; turn: range" and rows["z"].valid is None


def test_conversations_with_odd_rows(spark, sf):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "assistant", "y"), (3, 4, None, "z")],
        "conv_id long, turn long, role string, text string",
    )
    rows = sorted((r.conv_id or "", r.status, r.call_copies) for r in tool_links.conversation_links(turns).collect())
    assert rows == [("", "no_id", 1), ("1", "answered", 2), ("2", "no_id", None), ("3", "other", 1)]
    assert tool_links.conversation_links(table(spark, sf, "conversations").where("1 = 0")).count() == 0


def test_different_texts_of_one_turn_are_conflicts(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 1, "assistant", "s"), (1, 1, "assistant", "s"), (1, 2, "user", "t"), (1, 2, "user", "u"), (1, 3, "assistant", "v")]
        + [(1, 4, "user", "w"), (1, 5, "assistant", "x"), (None, 0, "user", "a"), (None, 0, "user", "b"), (2, None, "assistant", "c"), (2, None, "assistant", "d")],
        "conv_id long, turn long, role string, text string",
    )
    rows = tool_links.conversation_links(turns).collect()
    got = sorted((r.call_id or "", r.status, r.call_copies or 0, r.result_copies or 0) for r in rows)
    assert got == [("", "no_id", 0, 1)] * 2 + [("", "no_id", 1, 0)] * 2 + [("1:0", "conflict", 0, 1), ("1:0", "conflict", 0, 2), ("1:0", "conflict", 1, 0)] + [
        ("1:2", "conflict", 0, 1), ("1:2", "conflict", 1, 0), ("1:2", "conflict", 1, 0), ("1:4", "answered", 1, 1)
    ]
    assert {r.call_id: r.depth for r in rows if r.call_copies and r.call_id} == {"1:0": 0, "1:2": 1, "1:4": 2}
    assert all(any(f'"{x}"' in r.json for r in rows) for x in "qrstuvwxabcd")


def test_pipeline_stages(spark, sf, odd, empty):
    docs = table(spark, sf, "documents")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = spark.createDataFrame(step(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == {r.doc_id for r in kept.collect()} and all(r.round_trip for r in out.values())
    good = table(spark, sf, "labels").where("quality = 1").join(docs, "doc_id").where(F.size(F.split("text", r"\s+")) > 60)
    assert good.join(kept, "doc_id", "left_semi").count() > 0.8 * good.count()
    for rows in (odd, empty):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, rows, sf).columns == odd.columns
        assert len(corpus_pipeline.tokens(spark, rows, sf).collect()) == rows.count()


def test_kept_rows_with_columns_named_like_helpers(odd):
    names = {"fpt": F.lit("x"), "FP_": F.lit(1), "fpkeys": F.lit(None), "_metadata": F.lit("m"), "key": F.lit(2), "root": F.lit(3), "a": F.lit(4)}
    docs = odd.withColumns(names)
    kept = simhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
    assert {(r.fpt, r.FP_, r._metadata) for r in kept.collect()} == {("x", 1, "m")}


def test_fingerprints_of_similar_sets_are_near():
    """Pairs of Jaccard similarity 0.8 to 0.82 differ in few enough bits; far pairs don't."""
    rnd = np.random.default_rng(11)
    near = far = 0
    for _ in range(400):
        size = int(rnd.integers(20, 400))
        shared, own = int(round(0.81 * size)), size - int(round(0.81 * size))
        pool = rnd.integers(0, 1 << 63, shared + own, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cut = own // 2
        a, b, c = pool[: shared + cut], np.concatenate([pool[:shared], pool[shared + cut :]]), rnd.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        prints = [simhash.set_fingerprint(s) for s in (a, b, c)]
        near += (prints[0] ^ prints[1]).bit_count() <= simhash.NEAR
        far += (prints[0] ^ prints[2]).bit_count() <= simhash.NEAR
    assert near >= 0.93 * 400 and far <= 2


def test_index_finds_all_rows_near_a_query():
    rnd = np.random.default_rng(2)
    sizes = [1, 5, 300, 9]
    fps = [np.sort(rnd.integers(0, 1 << 20, n).astype(np.uint64)) for n in sizes]
    starts = np.cumsum([0, *sizes[:-1]])
    whole = np.concatenate(fps)
    index = simhash.GrayIndex(whole, starts)
    queries, bucket = rnd.integers(0, 1 << 20, 60).astype(np.uint64), rnd.integers(0, 4, 60)
    got = {(int(q), int(r), int(d)) for parts in index.near(queries, bucket, 6) for q, r, d in zip(*parts, strict=True)}
    want = {
        (q, int(r), (int(queries[q]) ^ int(whole[r])).bit_count())
        for q in range(60)
        for r in range(starts[bucket[q]], starts[bucket[q]] + sizes[bucket[q]])
        if (int(queries[q]) ^ int(whole[r])).bit_count() <= 6
    }
    assert got == want and want


def test_links_equal_sql_on_conflicts_and_other_roles(spark):
    """Conflicts, other and null roles, null ids and turns, a very long text and clashing columns."""
    long_text = "long text \\ \"quoted\" é " * 20_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 1, "assistant", "s"), (1, 2, "user", "t"), (1, 2, "user", "u"), (1, 3, "assistant", "v"), (1, 4, "user", "w")]
    rows += [(2, 0, "system", "rules"), (2, 0, "system", "rules"), (2, 1, "user", long_text), (2, 2, "assistant", ""), (2, 3, "user", ""), (2, 4, "tool", None), (2, 5, None, "n")]
    rows += [(None, 0, "user", "a"), (None, 0, "user", "b"), (3, None, "assistant", "c"), (3, None, "user", None), (4, 1, "assistant", "orphan"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"call_id": F.lit("x"), "Status": F.lit(1), "name": F.lit(None)})
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = tool_links.conversation_links(turns)
    assert differences(out, con, tool_links.SQL) == []
    assert sum((r.call_copies or 0) + (r.result_copies or 0) for r in out.collect()) == len(rows)


def test_main_text_without_article_tags(spark, sf):
    """The distribution finds the article on pages that do not name it."""
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    same = sum(main_text.main_text(re.sub(r"</?article[^>]*>", "", p)) == main_text.main_text(p) for p in pages)
    assert same >= 0.95 * len(pages)


def test_main_text_keeps_what_loose_names_would_lose():
    body = "This is a long paragraph of text, which goes on for a while so that it is over the threshold of a window."
    assert main_text.main_text(f"<article class='comment'><p>{body}</p></article><p>{body} Main.</p>") == f"{body} Main."
    assert main_text.main_text(f"<article><p>{body}</p><article class='user-comment'><p>{body}</p></article></article>") == body
    assert main_text.main_text("<article><h1>T</h1><p class='notice'>x<p>real text</article>") == "T\nreal text"
    assert main_text.main_text(f"<ul><li class='share'>x<li>{body}</ul><p>{body}") == f"{body}\n{body}"
    assert main_text.main_text(f"<div class='content has-sidebar'><p>{body}</p></div>") == body
    assert main_text.main_text(f"<form><p>{body}</p><nav>no</nav></form>") == body
    inner = f"<div class='post-header'><h1>Title</h1></div><p>{body}</p><section class='related-work'><p>{body}</p></section>"
    assert main_text.main_text(f"<article>{inner}</article>") == f"Title\n{body}\n{body}"
    assert main_text.main_text(f"<p>{body}</p><p><a href=x>linked words</a></p><p>{body}</p>") == f"{body}\nlinked words\n{body}"
    for name in ("user-comments", "site-footer", "cookieNotice", "nav-menu", "related-posts", "ad-slot", "sidebar left"):
        assert main_text.main_text(f"<p>{body}</p><div class='{name}'><p>{body} other</p></div>") == body, name


def test_main_text_of_odd_pages(spark):
    body = "word " * 60_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<p>{body}</p>"), (4, "u", "<p>same text here</p>"), (4, "u", "<p>same text here</p>"), (None, None, "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"Text": F.lit(1), "n_chars": F.lit("x"), "_text": F.lit(2)})
    got = sorted((r.page_id or 0, r.text) for r in main_text.extract(pages).collect())
    assert got == [(0, ""), (1, ""), (2, ""), (3, body.strip()), (4, "same text here"), (4, "same text here")]
    assert main_text.extract(pages.where("1 = 0")).count() == 0


@pytest.mark.parametrize("sent", [0, 3, 1000])
def test_near_duplicates_leave_texts_where_they_are(spark, monkeypatch, sent):
    """Ids are sent to the texts, whatever Spark takes for small; the same rows stay if there are too many ids to send."""
    words = [" ".join(f"w{random.Random(i).randrange(10**6)}x{j}" for j in range(60)) for i in range(10)]
    docs = spark.createDataFrame([(i, words[i % 10] + (" end" if i > 9 else "")) for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr("panelspark.llm.common.SENT_IDS", sent)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = simhash.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (sent == 0)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_search_among_near_copies_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, dtype=np.int64)
    bits = np.sort(base ^ (1 << rnd.integers(0, 60, 1500)) ^ (1 << rnd.integers(0, 60, 1500)))
    names = [i.to_bytes(16, "big") for i in range(1500)]
    zero, hundred = np.zeros(1500, np.int64), np.full(1500, 100)
    rows = [zero, zero.astype(np.int32), (np.arange(1500) >= 1000).astype(np.int32), bits, hundred.astype(np.int32), hundred.astype(np.int32), names, names]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], [*"abcdefgh"])
    tracemalloc.start()
    found = sum(b.num_rows for b in simhash._near_pairs(iter([batch]), 0, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 500 * 4 and peak < 40 << 20


def test_near_duplicates_send_texts_to_python_once(odd):
    marked = simhash._with_bands(odd.withColumn("Text2", F.lit("x")), "text", (*odd.columns, "Text2"), "mark")
    assert "_text" not in marked._jdf.queryExecution().executedPlan().toString()
    apart = simhash._with_bands(odd, "text", ("doc_id",), "mark")
    kinds = ["mark", "markn", "markbits", "markkeys"]
    both = [sorted((r.doc_id or 0, *(r[k] for k in kinds)) for r in rows.collect()) for rows in (marked, apart)]
    assert both[0] == both[1] and sorted(r.text or "" for r in marked.collect()) == sorted(r.text or "" for r in odd.collect())


def test_workers_drop_the_tables_of_earlier_operators(spark, odd):
    """A stage of other tasks leaves nothing of the tokenizer in the workers; its own tasks find it again."""

    def held():
        from panelspark.llm import bpe

        return lambda texts: [[bpe.load.cache_info().currsize + bpe._unlike.cache_info().currsize] * len(texts)]

    assert all(r.round_trip for r in corpus_pipeline.tokens(spark, odd, "").collect())
    rows = spark.range(400).withColumn("text", F.lit("some words")).repartition(200)
    map_texts(rows, "text", ["id"], [field("held", "int")], held).collect()
    last = map_texts(rows, "text", ["id"], [field("held", "int")], held).collect()
    assert {r.held for r in last} == {0}


def test_tables_stay_while_tasks_use_them(monkeypatch):
    monkeypatch.setattr(common, "_TABLES", {})
    made = []
    tables = common.worker_tables(lambda key: made.append(key) or key)
    for task in range(3 * common.UNUSED):  # operators that take turns in a worker
        common.drop_unused()
        if task % 2:
            tables("a")
    assert made == ["a"]
    for _ in range(common.UNUSED + 1):
        common.drop_unused()
    assert tables.cache_info().currsize == 0
    assert tables("a") == "a" and made == ["a", "a"]
