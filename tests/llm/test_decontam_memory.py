import tracemalloc

import pyarrow as pa

from corpusloom.llm.decontam import Index, compared


def test_memory_of_a_batch_is_that_of_a_slice():
    passage = " ".join(f"w{i}" for i in range(20))
    index = Index.of([7], [passage])
    texts = [" ".join(f"x{i * 500 + k}" for k in range(500)) for i in range(3000)]  # about 12 MB in one batch
    texts[2500] += " " + passage
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    list(compared([batch.slice(0, 10)], index, "text"))  # tables of characters
    tracemalloc.start()
    found = [(s.column(0)[t].as_py(), item, words) for s, rows in compared([batch], index, "text") for t, item, _, _, words, _ in rows]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(2500, 0, 20)]
    assert peak < 100 << 20  # slices of 4 MB took over 200
