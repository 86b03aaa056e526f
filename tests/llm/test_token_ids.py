"""Token ids in training order."""

import numpy as np
import public_tokenizers

from __spark_entry__ import queries
from turnwatch.llm import bpe, queries as Q, token_order


def test_shards_hold_the_token_ids_of_every_document(spark, small, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/shards"
    monkeypatch.setattr(Q, "new_folder", lambda *_: out)
    rows = queries()["op9_token_ids"](spark, small).orderBy("slot").collect()
    stored = list(token_order.read_slots(out, 0, 10**9, width=2))
    assert [r["slot"] for r in rows] == list(range(len(rows))) and len(stored) == len(rows)
    found = {}
    for r, s in sorted(zip(rows, stored), key=lambda x: (x[0]["doc_id"], x[0]["k"])):
        ids = np.frombuffer(s, "<u2")
        assert (ids[r["n_tokens"]:] == Q.END_ID).all()
        found.setdefault(r["doc_id"], []).extend(ids[:r["n_tokens"]].tolist())
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert found == {d["doc_id"]: [*enc.encode_ordinary(d["text"] or ""), Q.END_ID] for d in docs}
