import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_belong_together():
    import __spark_entry__

    from quillon import registry

    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "id", "score", "rank"]


def test_nothing_else_imports_llm():
    for file in [*(ROOT / "quillon").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" in file.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("quillon.llm") for n in names), file
