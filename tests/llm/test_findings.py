"""Tests of the third round's findings on operators."""

from __future__ import annotations

import zlib

import numpy as np

from listwright.llm import telephony


def test_op8_describes_all_samples(spark, folder):
    """Before, only one sample of four was described."""
    got = {r["doc_id"]: dict(x.split("=") for x in r["feature"].split(";")) for r in telephony.op8_telephony(spark, folder).collect()}
    for doc, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(40).collect():
        payload = text.encode().ljust(max(192, -(-len(text.encode()) // 192) * 192), b" ")
        form = telephony.form_of(payload)
        samples = telephony.to_pcm(form, payload, 192).astype(np.int64).tolist()
        # twice the rate: each sample, and the one half way to the next
        wide = [x for a, b in zip(samples, [*samples[1:], samples[-1]], strict=True) for x in (a, (a + b) // 2)]
        said = got[doc]
        assert (said["rate"], int(said["all_samples"]), int(said["all_peak"])) == ("16000", 2 * len(samples), max(map(abs, wide)))
        assert int(said["all_pcm"]) == zlib.crc32(np.array(wide, "<i2").tobytes())
        assert int(said["all_zc"]) == sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
