import ast
import os

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and "null_percentage" in df.columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "siftwell")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    for node in ast.walk(ast.parse(f.read())):
                        names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                        assert not any("siftwell.llm" in n for n in names), (folder, name)
