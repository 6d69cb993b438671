"""Every stage of the pipeline against a brute-force version of it, on the small tables."""

import pytest
from llm_help import texts
from test_scoring import brute_hits, brute_targets
from test_text_dedup import brute_lines, brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(sp):
    import corpus_pipeline as p

    from gridspark.session import settled

    docs, out = sp.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        after = settled(stage(sp, docs, SF))
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_stages_follow_each_other(stages):
    import corpus_pipeline as p

    assert [n for n, *_ in stages] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for _, _, after in stages[:-1]:
        assert after and tuple(after[0].asDict()) == p.COLUMNS


def test_toxic_documents_go(sp, stages):
    from gridspark.llm import toxicity

    _, before, after = stages[0]
    model = toxicity.fit(sp.read.parquet(f"{SF}/documents.parquet"), sp.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(after) == sorted(r for r in before if model.score((r.text or "").encode())[0] < toxicity.THRESHOLD)


def test_repeated_lines_go(stages):
    import hashlib

    _, before, after = stages[1]
    want = {d: h for d, _, _, h in brute_lines([(r.doc_id, r.text) for r in before])}
    assert {str(r.doc_id): hashlib.sha256((r.text or "").encode()).hexdigest() for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_one_near_duplicate_stays(stages):
    _, before, after = stages[2]
    kept = {d for d, _, c in brute_near([(r.doc_id, r.text) for r in before]) if d == c}
    assert sorted(after) == sorted(r for r in before if str(r.doc_id) in kept)


def test_contaminated_documents_go(sp, stages):
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in sp.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(after) == sorted(r for r in before if not brute_hits(r.text, items)[1])


def test_sources_meet_their_targets(stages):
    _, before, after = stages[4]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    target = brute_targets(sizes)
    for s in sizes:
        assert abs(sum(r.taken for r in after if r.source == s) - target[s]) <= 1
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)


def test_stages_take_an_empty_table(sp):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(sp, texts(sp, []), SF).count() == 0
