"""The pipeline's rows against a plain version of its stages after the trained one."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_near_duplicates import brute
from test_media_and_toxicity import chatter
from tracewright.llm import stages


def corpus():
    rng, rows = random.Random(11), []
    for i in range(260):
        body = chatter(rng, rng.randrange(3, 90), i % 5 == 1)
        head = "menu one | menu two" if i % 4 == 0 else ("rare head" if i % 70 == 3 else "")
        foot = "\n  all rights reserved " if i % 6 == 0 else ""
        rows.append([i, (head + "\n" if head else "") + body + foot, "en", f"s{i % 3}", 1])
    base = rows[7][1].split()
    for i in range(60):
        words = [w if rng.random() > 0.02 * (i % 4) else f"edit{rng.randrange(999)}" for w in base * 3]
        rows.append([1000 + i, " ".join(words), "en", f"s{i % 2}", 1])
    rows += [[1100 + i, "menu one | menu two", "en", "s0", 1] for i in range(5)]
    rows += [[2000, None, "en", "s0", None], [2001, "", None, None, 0], [2002, "word " * 9000, "en", "s1", 0], [2003, "a<|endoftext|>b", "en", "s2", 0]]
    return rows


def without_boilerplate(rows):
    """Rows as (id, text, site); lines on more than a tenth of a site's distinct texts, and two at least, go."""
    sites = {}
    for _, text, site in rows:
        if text is not None:
            sites.setdefault(site, set()).add(text)
    bad = {}
    for site, texts in sites.items():
        count = {}
        for t in texts:
            for line in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        bad[site] = {line for line, n in count.items() if n > 1 and n > 0.1 * len(texts)}
    out = {}
    for i, text, site in rows:
        cut = [x for x in (text or "").split("\n") if x.strip(" \t\r") in bad.get(site, ()) and x.strip(" \t\r")]
        out[i] = "\n".join(x for x in text.split("\n") if x not in cut) if cut else text
    return out


def test_run_equals_the_plain_version(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = stages.toxicity_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert 200 < len(clean) < len(rows)

    lined = without_boilerplate([(r["doc_id"], r["text"], r["source"]) for r in clean])
    ids = sorted(lined)
    _, least = brute([lined[i] for i in ids])
    single = [i for n, i in enumerate(ids) if least[n] == n]
    assert len(single) < len(ids) and any("menu" not in (lined[r["doc_id"]] or "") and "menu" in (r["text"] or "") for r in clean)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in single:
        own = np.array(tok.encode(lined[i] or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(own) - 1) % 2048 + 1, len(own) + 1, 2048)]
        want += [(i, n, a, b - a, zlib.crc32(own[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 2048
    assert len(filled) <= -(-sum(w[3] for w in want) // 2048) + 1
