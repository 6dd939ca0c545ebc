"""The pipeline's stages, each on its own input, against what their decisions must be."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import WORDS
from tidelog.llm import token_planes

STOP = "the of and to in is that for with on".split()


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)

    def prose(n):
        return " ".join(rng.choice(STOP) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n))

    items = [(k, prose(30)) for k in range(3)]
    docs = [(k, prose(rng.randrange(60, 150)), "en", f"s{k % 4}", 0) for k in range(60)]
    docs += [(100 + k, docs[k][1].replace("the", "The", 1), "en", "s0", 0) for k in range(10)]
    docs += [(200 + k, f"{prose(60)} {items[k][1]} {prose(40)}", "en", "s1", 0) for k in range(3)]
    docs += [(300, "too short", "en", "s1", 0), (301, "spam $$$ " * 80, "en", "s1", 0), (302, None, None, None, None), (303, "", "en", None, 0)]
    docs += [docs[0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert df.columns == columns
        kept.append(df.collect())
    passed = sorted(r.doc_id for r in kept[0])
    assert passed == sorted(d[0] for d in docs if d[0] < 300)
    assert sorted(r.doc_id for r in kept[1]) == [*range(60), 200, 201, 202]
    assert sorted(r.doc_id for r in kept[2]) == [*range(60)]
    sizes = {r.doc_id: len(r.text.split()) for r in kept[2]}
    taken = {}
    for r in kept[3]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * sizes[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 4
    library = Tokenizer.from_file(token_planes.default_tokenizer())
    start, want = 0, []
    for r in sorted(kept[3], key=lambda r: (r.doc_id, r.text)):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, kept[4])) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
    assert not re.search(r"\$", " ".join(r.text for r in kept[3]))
