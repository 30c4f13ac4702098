from collections import Counter

import corpus_pipeline
from tidewright.llm import decontaminate, minhash, mixing, toxicity
from tidewright.llm.common import Scratch, table
from tidewright.llm.queries import WEIGHTS, domain_model

from .test_near_duplicates import linked, plain_sets
from .test_sharding import plain_jump


def test_each_stage_against_a_plain_version(spark, sf_dir):
    docs, scratch, kept = table(spark, sf_dir, "documents"), Scratch(spark, "t"), []
    columns, before_mix = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before_mix = docs
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    whole = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}

    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    known = [d for d in whole if labels.get(d) in (0, 1)]
    right = sum((d in kept[0]) == (labels[d] == 0) for d in known)
    assert right >= 0.9 * len(known)

    before = sorted(kept[0])
    sets = plain_sets([kept[0][d] for d in before], 5)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert set(kept[1]) == {before[c] for c in set(linked(len(before), pairs))}

    items = [decontaminate.normal(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    exact = {d for d, t in kept[1].items() if any(x in decontaminate.normal(t) for x in items)}
    assert exact and not exact & set(kept[2])
    assert len(kept[1]) - len(kept[2]) == len(exact)

    assert kept[3] == kept[2]
    # every document as often as its rate says, which is the same for a plain count of the rows
    model = domain_model(before_mix, table(spark, sf_dir, "labels"))
    copies = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix(before_mix, model, WEIGHTS, least=1.0).collect()}
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(copies) and max(copies.values()) > 1 == min(copies.values())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect()) and {r["doc_id"] for r in out} == set(kept[3])
    assert all(r["shard"] == plain_jump(r["doc_id"], 8) for r in out)


def test_names_and_order():
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "benchmark", "mixing", "sharding"]
    assert minhash.Rule() == minhash.Rule(5, 80) and toxicity.THRESHOLD == 0.3
