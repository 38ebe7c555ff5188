"""Registered queries and the pipeline on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

entries = pytest.importorskip("boxlake.llm.entries")


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_equals_oracle(spark, duck, name):
    same_rows(entries.queries()[name](spark, SMALL), duck.sql(entries.ORACLE_SQL[name]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 14))


def test_registered():
    import __spark_entry__

    assert set(entries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_equals_brute_force(spark):
    """Each stage from plain Python over the stage before; only the fitted classifier is shared."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import re
    from collections import Counter

    from boxlake.llm.bpe import encoder, round_trip
    from boxlake.llm.common import tokenizer, words_of
    from boxlake.llm.decontaminate import shingles
    from boxlake.llm.quality import THRESHOLD, fit_quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {d: t for d, s, t in zip(rows, model.scores(list(rows.values())), rows.values()) if s >= THRESHOLD}

    def parsed(line):
        raw = tuple(w for w in re.split(r"[\x20\x09-\x0d]+", line) if w)
        masked = tuple("<*>" if re.search("[0-9]", w) else w for w in raw)
        return masked, (raw if set(masked) <= {"<*>"} else masked), (len(raw), masked[:3])

    lines = [(t, i, *parsed(line)) for t in set(rows.values()) for i, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    leaves: dict = {}
    for t, _, masked, own, leaf in lines:
        texts, templates = leaves.setdefault(leaf, (set(), {}))
        texts.add(t)
        templates[own] = [(p, w) for p, w in enumerate(masked) if p >= 3 and w != "<*>"]
    group = {}
    for leaf, (texts, templates) in leaves.items():
        if len(texts) < 10:
            continue
        votes = Counter(x for spots in templates.values() for x in spots)
        families: dict = {}
        for own, spots in templates.items():
            group[leaf, own] = [(leaf, own)]
            for x in sorted(spots, key=lambda x: (-votes[x], x[0]))[:3]:
                families.setdefault(x, []).append(own)
        for anchor, members in families.items():
            votes_ = Counter(x for own in members for x in templates[own])
            for own in members:
                if sum(2 * votes_[x] > len(members) for x in templates[own]) >= 0.6 * (leaf[0] - 3) - 1e-9:
                    group[leaf, own].append((leaf, "family", anchor))
    seen: dict = {}
    for t, _, _, own, leaf in lines:
        for g in group.get((leaf, own), []):
            seen.setdefault(g, set()).add(t)
    gone = {(t, i) for t, i, _, own, leaf in lines if any(len(seen[g]) >= 10 for g in group.get((leaf, own), []))}
    rows = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (t, i) not in gone) for d, t in rows.items()}

    sets = {d: frozenset(shingles(words_of(t, lower=True))) for d, t in rows.items()}
    top = {d: d for d in rows}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    rows = {d: t for d, t in rows.items() if root(d) == d}

    items = [frozenset(shingles(words_of(r.text, lower=True))) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if not any(len(i & sets[d]) >= 0.8 * len(i) - 1e-9 for i in items)}
    want = {(d, *round_trip(t, encoder(tokenizer("byte_bpe_50k.json")))) for d, t in rows.items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_stages_take_odd_tables(spark):
    """Nulls, empties, repeats, clashing columns and empty tables pass all stages; columns stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6, None, None, None, None), (None, "no id", "en", "x", 5), (10**6 + 1, "", "en", "x", 0), (10**6 + 1, "word " * 30000, "en", "x", 150000)], docs.schema)
    wide = docs.unionByName(odd).selectExpr("*", "1 as _n_lines", "'k' as _key", "2 as _places", "3 as label", "4 as row", "5 as score")
    for table in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SMALL)
            assert out.columns == wide.columns, name
            rows = out.collect()
            assert {(r._n_lines, r._key, r._places) for r in rows} <= {(1, "k", 2)} and (rows or table is not wide), name
        assert corpus_pipeline.STAGES[-1][1](spark, table, SMALL).count() == table.count()
