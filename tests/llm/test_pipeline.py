"""The pipeline's stages against plain re-statements of what they decide, and the registered queries against their SQL."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from corpusmill.llm import decontaminate, entry, nearcopies, simhash, toxicity
from corpusmill.llm.common import materialize
from tests.llm.test_operators import DOC, ODD, brute_cut, check_packing, ids_of

SF = "/root/testdata/sf0.001"


def near_groups(rows):
    """Sets of ids chained by a similarity of 4/5 or more of five-word shingles, by comparing all texts that share one."""
    sets, post = [], defaultdict(list)
    for i, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})  # blank texts: one empty shingle
        for g in sets[-1]:
            post[g].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, own in enumerate(sets):
        for j in {j for g in own for j in post[g] if j < i}:
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].add(doc)
    return list(groups.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substring", "decontamination", "packing"]
    clean = materialize(stages["toxicity"](spark, docs, SF), "t")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.categories())
    toxic = [r.doc_id for r in docs.collect() if toxicity.predict(chain, toxicity.features_of(r.text))[1] >= chain[1].threshold]
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in docs.collect()} - set(toxic)) and clean.columns == columns
    once = materialize(stages["near_duplicates"](spark, clean, SF), "n")
    want = sorted(map(min, near_groups([(r.doc_id, r.text) for r in clean.collect()])))
    assert sorted(r.doc_id for r in once.collect()) == want and once.columns == columns
    cut = materialize(stages["substring"](spark, once, SF), "s")
    kept = {d: (k if n else None) for d, _, n, k in brute_cut([(r.doc_id, r.text) for r in once.collect()])}
    before = {r.doc_id: r.text for r in once.collect()}
    for r in cut.collect():
        assert r.text == (before[r.doc_id] if kept[r.doc_id] is None else kept[r.doc_id]) and (r.n_chars == len(r.text) or kept[r.doc_id] is None)
    assert cut.count() == once.count() and cut.columns == columns
    safe = materialize(stages["decontamination"](spark, cut, SF), "d")
    items = [" ".join(decontaminate._words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in cut.collect() if any(f" {i} " in f" {' '.join(decontaminate._words(r.text))} " for i in items)}
    left = {r.doc_id for r in safe.collect()}
    assert not left & leaks and len({r.doc_id for r in cut.collect()} - left - leaks) <= 1 and safe.columns == columns
    placed = stages["packing"](spark, safe, SF).collect()
    tokens = sum(len(ids_of(r.text)) // 4 for r in safe.collect())
    assert sum(r.length for r in placed) == tokens
    check_packing([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed], placed)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_stages_on_odd_tables(spark):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as fp", "2 as component_id", "3 as spans")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), "odd")
            assert docs.columns == [*[c.split()[0] for c in DOC.split(", ")], "fp", "component_id", "spans"]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.count() >= docs.count()


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = c.execute(entry.ORACLES[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
    df = entry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names and sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want


def test_every_operator_is_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in found


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six", "something else entirely and longer than that"
    rows = [(None, a, None, None, 1), (None, b, None, None, 1), (3, b.upper(), None, None, 1), (3, b.upper(), None, None, 1), (7, "", None, None, 0), (8, None, None, None, 0), (None, a, None, None, 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, a), (3, b.upper()), (7, "")], key=str)


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng, rows = random.Random(5), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    vocabulary = [f"w{k}" for k in range(400)]
    for c in range(12):  # clouds of near copies around one text, at similarities on both sides of 4/5
        base = rng.choices(vocabulary, k=rng.randrange(40, 160))
        for k in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((10_000 + 100 * c + k, "  ".join(own).upper() if k % 7 == 0 else " ".join(own)))
    rows += [(20_000, ""), (20_001, None), (20_002, "one two"), (20_003, "One  two")]
    groups = near_groups(rows)
    df = spark.createDataFrame([(d, t, None, None, len(t or "")) for d, t in rows], DOC)
    for block in (nearcopies.LIST, 8):  # lists in one piece, and dealt in pairs of blocks
        monkeypatch.setattr(nearcopies, "LIST", block)
        kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
        assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in groups)


def test_near_copies_are_linked_by_trees(spark, monkeypatch):
    rng, found = random.Random(3), []
    fps = [rng.getrandbits(64) for _ in range(300)]
    for fp in list(fps):  # chains of texts at one to five bits, and texts of equal fingerprints
        for _ in range(rng.randrange(4)):
            for bit in rng.sample(range(64), rng.randrange(6)):
                fp ^= 1 << bit
            fps.append(fp)
    rows = [(k, int(np.uint64(fp).view(np.int64))) for k, fp in enumerate(fps)]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash_radius()]
    links = nearcopies._tree_links(spark.createDataFrame(rows + rows[:9], "key long, fp long")).collect()
    assert all(r.a < r.b for r in links) and partition(len(fps), near) == partition(len(fps), links)

    trees, likely = nearcopies._tree_links, nearcopies._likely
    monkeypatch.setattr(nearcopies, "_tree_links", lambda indexed: found.append(trees(indexed)) or found[-1])
    monkeypatch.setattr(nearcopies, "_likely", lambda pairs, wanted: found.append((set(found[0].collect()), set(pairs.collect()))) or likely(pairs, wanted))
    base = " ".join(f"w{k}" for k in range(300))
    texts = [base, f"{base} more", "another text of no copies at all"]
    df = spark.createDataFrame([(d, t, None, None, len(t)) for d, t in enumerate(texts)], DOC)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()) == [0, 2]
    linked, checked = found[1]
    assert linked and linked <= checked


def simhash_radius():
    return simhash.near_duplicates.__defaults__[1]


def partition(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = label[a], label[b]
        label = [new if x == old else x for x in label]
    groups = defaultdict(set)
    for i, x in enumerate(label):
        groups[x].add(i)
    return sorted(map(sorted, groups.values()))


def star_texts(rng, spokes=60):
    """A text and variants of it that are alike to it only: between two of them the similarity is just below 4/5."""
    base = [f"w{k}" for k in range(2004)]
    texts = [" ".join(base)]
    for v in range(spokes):
        own = list(base)
        for at in range(26):
            own[at * 77 + rng.randrange(70)] = f"v{v}x{at}"
        texts.append(" ".join(own))
    return texts


def test_candidates_of_a_group_do_not_make_its_square(spark):
    members = []
    for text in star_texts(random.Random(8)):
        tokens = nearcopies._tokens(text.encode())
        own = nearcopies.grams(tokens)
        signed = lambda x: int(np.uint64(x).view(np.int64))
        key = signed(nearcopies._key(tokens))
        members.append((key, key, len(own), signed(nearcopies.vote(own.view(np.uint64))), bytearray(nearcopies._sketch(own)), own.tolist()))
    fields = "key: bigint, root: bigint, n: bigint, fp: bigint"
    lists = spark.createDataFrame([([m[:5] for m in members],)], f"members array<struct<{fields}, sketch: binary>>")
    forest = nearcopies._across(lists).collect()
    assert len(forest) == len(members) - 1  # its 61 texts are one group of candidates; their pairs are 1830
    groups = spark.createDataFrame([([m[:4] + m[5:] for m in members],)], f"members array<struct<{fields}, grams: array<bigint>>>")
    assert {(r.a, r.b) for r in nearcopies._joined(groups).collect()} == {(min(m[0], members[0][0]), max(m[0], members[0][0])) for m in members[1:]}


@pytest.mark.parametrize("group", [nearcopies.GROUP, 20_000])
def test_stars_of_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(nearcopies, "GROUP", group)  # candidates in one group, and in pairs of blocks
    texts = star_texts(random.Random(8))
    for rows in ([*enumerate(texts)], [*enumerate(texts)][1:]):  # without their middle the variants are no near copies
        df = spark.createDataFrame([(d, t, None, None, len(t)) for d, t in rows], DOC)
        kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
        assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in near_groups(rows))


def test_long_unlike_texts_are_no_candidates(spark):
    rng = np.random.default_rng(4)
    shared = np.unique(rng.integers(-(1 << 62), 1 << 62, 2000))

    def member(key, own):
        return key, key, len(own), 0, bytearray(nearcopies._sketch(own))  # one fingerprint: counts alone decide

    grown = lambda n: np.unique(np.concatenate([shared[: n // 4], rng.integers(-(1 << 62), 1 << 62, n - n // 4)]))
    unlike = [member(k, grown(8000)) for k in range(20)]  # 256 buckets would have 31 shingles each
    alike = [member(100, shared[:1000]), member(101, shared[:1100]), member(102, shared[:1024]), member(103, shared[:1025])]  # with 256 and 512 buckets
    fields = "key: bigint, root: bigint, n: bigint, fp: bigint, sketch: binary"
    lists = spark.createDataFrame([(unlike,), (alike,)], f"members array<struct<{fields}>>")
    assert sorted((r.a, r.b) for r in nearcopies._across(lists).collect()) == [(100, 101), (100, 102), (100, 103)]


def test_texts_without_a_partner_leave_their_list(spark):
    rows = [(7, [(1, 1, 100, 0), (2, 2, 90, 7), (3, 3, 100, -1), (4, 4, 60, 0)]), (8, [(1, 1, 100, 0), (5, 1, 100, 0)])]
    lists = spark.createDataFrame(rows, "h long, members array<struct<key: bigint, root: bigint, n: bigint, fp: bigint>>")
    assert sorted((r.h, r.key) for r in nearcopies._apart(lists).collect()) == [(7, 1), (7, 2)]
