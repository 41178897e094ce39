import os

from lociforge.llm.linking import cross_pairs
from lociforge.session import Cut


def test_cross_pairs_keep_only_their_result(spark):
    cut = Cut(spark)
    rows = [(key, node, node // 3) for key in range(5) for node in range(9) if (node + key) % 4]
    placed = cut.write(spark.createDataFrame(rows, "key long, node long, comp long"))
    got = {tuple(r) for r in cross_pairs(placed, cut).collect()}
    want = {}
    for key, a, ca in rows:
        for other, b, cb in rows:
            if key == other and a < b and ca != cb:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == {(a, b, n) for (a, b), n in want.items()}
    assert len(os.listdir(cut.folder.removeprefix("file://"))) == 1
    cut.close()
