"""Each operator against a brute-force version, a round trip or SQL, and its defined edge cases."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import archives, chat, decontaminate, exact_dedup, licenses, mixing, render, shared, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["fp", "toks", "windows", "size", "path", "row", "digest", "first_doc", "bad_id", "_row", "_size", "_id", "part", "component_id", "_t", "value"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 30_000)
    texts = [None, "", " \t\n", "One", "one", prose(2, 200), prose(2, 200), prose(2, 200).upper(), long, long + " end", prose(3, 50) + " idiot", "É é " + prose(4, 20)]
    out = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[5], (None, prose(5, 30), None, "s1", None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


# --- SimHash --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_by_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r[0], f) for r, f in zip(rows, fps, strict=True))
    label = brute_components(fps)
    least = defaultdict(lambda: None)
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = r[0] if least[c] is None else min(least[c], r[0])
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], least[c]) for r, c in zip(rows, label, strict=True))


def test_native_hash_is_the_library_s(spark):
    text = "größer than a"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sets(st.integers(0, 63), max_size=4)), min_size=1, max_size=60), st.integers(0, 2**64 - 1))
def test_trie_finds_every_link(flips, seed):
    centres = [(seed * (k + 1) * 0x9E3779B97F4A7C15) % 2**64 for k in range(4)]
    codes = sorted({c ^ sum(1 << b for b in bits) for c, bits in ((centres[k], bits) for k, bits in flips)})
    found = set()
    for by in (0, 16, 32, 48):
        turned = sorted(((c << by | c >> (64 - by)) % 2**64, c) for c in codes)
        groups = [i for i in range(len(turned)) if i == 0 or turned[i][0] >> 48 != turned[i - 1][0] >> 48]
        a, b = simhash.trie_links(np.array([t for t, _ in turned], np.uint64), np.array(groups))
        found |= {tuple(sorted((turned[i][1], turned[j][1]))) for i, j in zip(a, b, strict=True)}
    assert found == {(x, y) for x in codes for y in codes if x < y and bin(x ^ y).count("1") <= 3}


def test_a_crowded_node_is_cut_into_chunks(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)})
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    star = {x.node % 2**64: x.root for x in simhash.stars(simhash.forests(table, node_rows=16)).collect()}
    label = brute_components(fps)
    groups, expected = defaultdict(set), defaultdict(set)
    for f, c in zip(fps, label, strict=True):
        groups[star.get(f, f)].add(f)
        expected[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_one_document_of_each_group_stays(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    groups = simhash.near_duplicates(docs).collect()
    root = {(r.doc_id, r.fp % 2**64): r.root for r in groups}
    assert len(got) == len({r.root for r in groups}) == len({root[r.doc_id, brute_fingerprint(r.text)] for r in got})
    assert {r.doc_id for r in got} == {r.component_id for r in groups}


def test_more_bits_are_refused(docs):
    with pytest.raises(ValueError):
        simhash.forests(docs.select(F.col("doc_id").alias("fp")), max_bits=4)


# --- licences -------------------------------------------------------------------------------------


def test_licence_texts_in_other_layouts(spark):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT")
    british = mit.replace("sublicense", "sublicence").replace(", ", " ,\n  ").upper()
    texts = [mit, "Copyright (c) 2020 A. Holder\n\n" + british, "(c) 1999 x\n" + mit, mit + " and more", "first\nReleased under the MIT  licence!\nlast", None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(7)] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert got[4].notice_ids == "MIT" and got[5].text_digest == got[6].text_digest == hashlib.sha256(b"").hexdigest()


def test_licence_scan_keeps_every_row(docs, rows, none):
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(none).count() == 0


# --- decontamination --------------------------------------------------------------------------------

QUESTION = "A train leaves the station of Anna at 9 and travels 120 km to the town where Boris waits; how many hours does the train need if it covers 60 km in an hour and stops twice on the way"


def contaminated(spark, texts, items=(QUESTION,), **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, **options).collect()}


def test_verbatim_and_reparameterised_questions_are_caught(spark):
    other = QUESTION.replace("Anna", "Clara").replace("Boris", "Dora").replace("120", "350").replace("60", "70")
    mixed = QUESTION.replace("120 km to", "60 km to")  # two values of the item become one
    texts = [prose(9, 40) + " " + QUESTION + " " + prose(8, 30), QUESTION.lower().replace(";", " - "), prose(7, 20) + ". " + other, prose(6, 200), None, "", mixed]
    got = contaminated(spark, texts)
    assert set(got) == {(0, 0), (1, 0), (2, 0)} or set(got) == {(0, 0), (2, 0)}
    assert got[0, 0].coverage == 1 and got[0, 0].n_changed == 0 and got[2, 0].n_changed >= 3


def test_short_items_and_empty_tables(spark, docs, none):
    assert set(contaminated(spark, ["just five plain words here", "just five plain words here and more"], ["just five plain words here"])) == {(0, 0)}
    bench = spark.createDataFrame([(1, QUESTION), (None, None)], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_windows_by_brute_force(spark):
    item = prose(11, 40)
    texts = [prose(20 + k, 30) + " " + " ".join(item.split()[k : k + 20]) + " " + prose(40 + k, 30) for k in range(0, 20, 3)]
    got = contaminated(spark, texts, [item], coverage=0.0)
    assert {k: v.n_windows for k, v in got.items()} == {(i, 0): 13 for i in range(len(texts))}


def test_dropping_contaminated_keeps_the_rest(spark, docs, rows):
    bench = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in rows if (r[1] or "").lower() != rows[5][1])


# --- toxicity -------------------------------------------------------------------------------------


def labelled(spark, n=400, seed=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(400)]
    rude = ["blorgface", "snarkwit", "grumpod", "vexling"]
    rows, marks = [], []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(20, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(rude)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = toxicity.score_held_out(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert sum(r.predicted for r in held if not r.toxic) <= 0.05 * len(held)


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(spark, 120)
    held = toxicity.fold(F.col("doc_id")) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.score_held_out(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 0), (10, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_held_out(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(0 <= r.score <= 1 for r in toxicity.score_held_out(docs, labels.where("false")).collect())
    assert toxicity.score_held_out(none, labels).count() == 0
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + c % 26 for c in b)), st.integers(0, 5), st.integers(0, 5)), min_size=2, max_size=40, unique_by=lambda x: x[0]))
def test_ratios_are_finite_and_vanish_for_equal_classes(words):
    w = [x for x, _, _ in words]
    t, o = (np.array([x[i] for x in words], float) + 1 for i in (1, 2))
    assert np.isfinite(toxicity.train(w, t, o).ratios(w)).all()
    assert np.allclose(toxicity.train(w, t, t).ratios([*w, b"unseen"]), 0)


# --- HTML -----------------------------------------------------------------------------------------

PAGES = {
    "": "",
    "<p>a<p>b": "a\n\nb",
    "a &amp; b<br>c": "a & b\nc",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
    "<table><tr><th>n<th>value<tr><td>long one<td>2</table>": "n         value\nlong one  2",
    "<table><tr><td>a<br>b<td>c</table>x": "a  c\nb\n\nx",
    "x<script>if (a < b) '</p>'</script>y<style>p{}</style>z": "xyz",
    "<style>.h{display:none} #q{visibility:hidden}</style><div class='x h'>no</div><p id=q>no<b style='visibility:visible'>yes</b></p>": "yes",
    "<div hidden>no</div><div style='display: none'>no</div>yes<input type=hidden value=no>": "yes",
    "<title>no</title><noscript>yes</noscript><!-- no --><template>no</template>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\n\nt\nyes",
    "<pre>a\n  b</pre>": "a\n  b",
    "<b>a</b><i> b</i>\n\n c": "a b c",
    "</div><p>a</span></p>b<": "a\n\nb<",
    "<div>" * 5000 + "deep" + "</div>" * 5000: "deep",
    "<p>a<table><tr><td>x<p>y</table>": "a\n\nx\n\ny",
}


@pytest.mark.parametrize(("html", "text"), PAGES.items())
def test_rendering(html, text):
    assert render.render(html) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td colspan=2>", "</table>", "<li>", "<ul>", "</ul>", "text", " ", "<b", "&lt;", "<!--", "-->", "<pre>", "</pre>", "<script>", "</script>", "<div hidden>", "</div>"]), max_size=40).map("".join))
def test_any_markup_is_rendered(html):
    assert isinstance(render.render(html), str)


def test_rendering_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "")], "page_id long, html string").withColumn("text", F.lit("x"))
    assert sorted(map(tuple, render.render_pages(pages).collect()), key=str) == [(1, "a"), (1, "a"), (2, ""), (None, "")]
    assert render.render_pages(pages.where("false")).count() == 0


# --- exact dedup ------------------------------------------------------------------------------------


def lowered(text):
    return (text or "").encode().lower()


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    return Counter((r[0], max((i for i in groups[lowered(r[1])] if i is not None), default=None), len(groups[lowered(r[1])]), hashlib.sha256(lowered(r[1])).hexdigest()) for r in rows)


@pytest.mark.parametrize("digest_bytes", [32, 0])
def test_exact_groups_by_brute_force(spark, docs, rows, tmp_path, digest_bytes):
    docs.repartition(3).write.parquet(path := str(tmp_path / "documents.parquet"))
    got = exact_dedup.deduplicate(spark, path, digest_bytes=digest_bytes).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows)
    assert sum(r.kept for r in got) == len({lowered(r[1]) for r in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, home = str(tmp_path / "documents.parquet"), str(tmp_path / "home")
    for part in ([(1, "a"), (2, "A"), (3, "b")], [(4, "a"), (5, "c")]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(spark, path, home).collect()}
    assert got == {1: (4, 3), 2: (4, 3), 4: (4, 3), 3: (3, 1), 5: (5, 1)}


def test_one_file_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "one.parquet")
    assert exact_dedup.deduplicate(spark, str(tmp_path / "one.parquet")).count() == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none.parquet"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "none.parquet")).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), epochs=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), epochs * sum(sizes.values())
    while True:
        room = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and room * weight[s] / open_ > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else room * weight[s] / open_ for s in names}
        full |= over


def corpus(spark, seed=0, n=300):
    r = random.Random(seed)
    rows = [(i, prose(i, r.randint(0, 60)), None if r.random() < 0.1 else f"s{min(r.randrange(9), r.randrange(9))}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))


def test_mix_meets_its_targets(spark):
    rows, df = corpus(spark)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    got = mixing.mix(df, shard_words=700).collect()
    assert all(r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 16 * (2 + sizes[s] / 700) for s in sizes)
    again = mixing.mix(df.repartition(7, "text"), shard_words=700).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_apportionment_by_brute_force(spark):
    r = random.Random(5)
    for total in (0, 1, 7, 40):
        shares = [r.choice([0.0, r.random() * 10]) for _ in range(6)] + [1.0]
        table = spark.createDataFrame([(0, k, s, total, 1000) for k, s in enumerate(shares)], "g int, k int, share double, seats long, most long")
        got = {x.k: x.won for x in mixing.apportion(table, ["g"], ["k"], "share", "seats", "most", "won").collect()}
        won = Counter()
        for _ in range(total):
            won[max(range(len(shares)), key=lambda k: (shares[k] / (2 * won[k] + 1), -k))] += 1
        assert got == {k: won[k] for k in range(len(shares))}


def test_applied_mix_has_the_words_taken(spark, docs, rows, none):
    data, df = corpus(spark, 1)
    plan = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got = Counter()
    for r in mixing.apply_mix(df).collect():
        assert r.n_chars == len(r.text) and (r.text in data[r.doc_id][1] or len(r.text.split()) < len(data[r.doc_id][1].split()))
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix(docs).count() == len(rows) and mixing.mix(none).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(none).count() == 0
    assert sum(r.taken for r in mixing.mix(docs).collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.apply_mix(docs).collect())


# --- token files ----------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_token_files_round_trip(spark, docs, rows, none, tokenizer, tmp_path):
    uri = str(tmp_path / "tokens")
    manifest = shared.cut(tokens.write_shards(docs.repartition(3), uri, VOCABULARY, sequence=64))
    got = sorted(tokens.read_documents(manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    expected = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter({(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())): n for (d, i), n in expected.items()})
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    shard = manifest.orderBy("shard").first()
    table = tokens.read_sequences(shard.path)
    ids = table["input_ids"].combine_chunks().flatten().to_numpy()
    mask = table["mask"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    assert len(ids) == 64 * shard.n_sequences and mask.sum() == shard.n_tokens and mask[: shard.n_tokens].all()
    assert tokens.read_documents(shared.cut(tokens.write_shards(none, str(tmp_path / "none"), VOCABULARY))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBé ß\t\n.,;:!?'’1²<|>ıİΣς\u0301\u00a0\u2028\x1c_-endoftext", max_size=40) | st.sampled_from(["<|endoftext|>", "x<|ENDOFTEXT|>,", "it's we'RE,", "a.b, c!"]), max_size=6))
def test_ids_by_word_are_those_of_the_text(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY) if not hasattr(test_ids_by_word_are_those_of_the_text, "t") else test_ids_by_word_are_those_of_the_text.t
    test_ids_by_word_are_those_of_the_text.t = whole
    assert tokens.check_splits(open(VOCABULARY, encoding="utf-8").read())
    got = tokens.Encoder(VOCABULARY, words_held=8)([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


# --- archives -------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_are_read_by_their_lengths(version):
    block = archives.http_block(b"a\n\nhttp://x 0 0 t 9\n", 7)
    fields = {"url": "http://a/", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html", "result": 200, "length": len(block)}
    data = archives.arc_head(version, "x.arc") + (archives.arc_line(version, fields) + block + b"\n") * 2
    (head, _), (one, content), (two, _) = archives.read_arc(io.BytesIO(data))
    assert head["url"].startswith("filedesc:") and content == block and one["date"] == two["date"] == "20010203040506"
    assert archives.warc_date(one["date"]) == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(data[:-30])))


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ b", "<p>x"), (2, None, None), (3, "http://c", ""), (4, "http://d", "<p>x"), (5, "u", "é" * 50_000), (5, "u", "é" * 50_000), (None, "n", "<p>x"), (0, "z", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit("x")).repartition(3)
    got = archives.archive(df, str(tmp_path / "w")).collect()
    kept, sha = {}, lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    for i, _, h in pages:
        kept[sha(h)] = max(kept.get(sha(h), -1), -1 if i is None else i)
    assert Counter((r.key, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), sha(h)) for i, _, h in pages)
    for r in got:
        assert r.refers_to == (kept[r.payload_digest] if r.record_type == "revisit" else None)
    assert Counter(r.payload_digest for r in got if r.record_type == "response") == Counter(kept.keys())
    assert archives.archive(df.where("false"), str(tmp_path / "none")).count() == 0
    assert all(r.record_type == "response" for r in archives.archive(df.where("page_id in (1, 4)"), str(tmp_path / "min"), min_revisit_bytes=5).collect())


# --- chat -----------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def brute_summary(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, ts in turns.items():
        loss = "".join(x for _, r, x in sorted(ts) if r.lower() == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(ts))), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|im_end|>\\", "\\<|im_start|>\\\\", "<\\/s>", "<<SYS>>", "", None, "a\nb", "é\U0001f600"]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(tricky)]
    rows += [(2, 0, "system", prose(1, 50))] + [(2, k, ["user", "assistant"][k % 2 - 1], prose(k, 3 + 97 * (k % 5))) for k in range(1, 40)]
    rows += [(None, 0, None, "x"), (3, 0, "assistant", prose(3, 5000)), (3, 1, "user<|im_sep|>", "q"), (4, 5, "user", "same"), (4, 5, "user", "same"), (5, None, "assistant", "first"), (5, 0, "assistant", "then")]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("window", F.lit("x"))
    out = shared.cut(chat.windows(df))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.summary(out).collect()}
    assert got == brute_summary(rows)
    held = [r for r in out.collect() if r.conv_id == 2]
    assert len(held) > 3 and all(r.formatted.startswith("<|im_start|>system<|im_sep|>") for r in held)
    assert sorted(r.n_context for r in held)[-1] == 3 and max(len(re.findall(r"\S+", r.formatted)) for r in held) <= chat.BUDGET
    assert chat.windows(df.where("false")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="\\<>|[]/sINSTim_endart", max_size=60))
def test_escapes_are_reversible(text):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(text,)], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    e, back = df.select("e", chat.unescaped(F.col("e"))).first()
    assert back == text and not any(c in e for c in chat.CONTROLS)
