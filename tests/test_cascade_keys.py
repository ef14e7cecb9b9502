"""A cascade works out the keys that each parent loses once; tables below read those, not the parents again."""

from corpusloom.operators import cascade
from corpusloom.sources.store import Store


def test_tables_below_read_written_keys(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"), buckets=2)
    make = lambda rows, fields: (spark.createDataFrame(rows, fields), [fields.split()[0]])
    own.create({
        "papers": make([(i, f"p{i}") for i in range(6)], "id long, slug string"), "repos": make([(10 + i, i) for i in range(6)], "id long, paper_id long"),
        "members": make([(i, k) for k, n in (("paper", 0), ("repo", 10)) for i in range(n, n + 6)], "target_id long, target_kind string"), "code_files": make([(10 + i, "x") for i in range(6)], "repo_id long, path string"),
    })
    marked, counts = cascade.plan(own, "papers", spark.createDataFrame([(1,), (4,), (99,), (None,)], "id long"))
    assert {n: c["deleted"] for n, c in counts.items()} == {"papers": 2, "repos": 2, "members": 4, "code_files": 2}
    for name, parents in (("repos", ["papers"]), ("members", ["papers", "repos"]), ("code_files", ["repos"])):
        files = marked[name].inputFiles()
        assert all(any(f"lost-{p}" in f for f in files) for p in parents)
        assert not any("/tables/papers/" in f or (name != "repos" and "/tables/repos/" in f) for f in files)
