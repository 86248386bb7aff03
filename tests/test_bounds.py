"""Loops end when nothing is left to do."""

from strataflow.operators import tree


def test_trees_of_more_than_eight_levels(spark, monkeypatch):
    """A level that joins its first two nodes only."""

    def level_function(depth, summarise, max_clusters, part):
        def summarised(pdf):
            import pandas as pd

            own = pdf.sort_values("at")["node"].tolist()
            parts = [own[:2], *([n] for n in own[2:])] if len(own) > 1 else []
            return pd.DataFrame([(1, depth, f"{depth}-{i}", i, "text", p) for i, p in enumerate(parts)], columns=["doc_id", "level", "node", "at", "content", "children"])

        return summarised

    monkeypatch.setattr(tree, "_level_function", level_function)
    chunks = spark.createDataFrame([(1, i, "text") for i in range(11)], "doc_id long, sequence int, content string")
    levels = [r["level"] for r in tree.summary_tree(chunks).collect()]
    assert max(levels) == 10 and levels.count(10) == 1
