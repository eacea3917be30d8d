import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, docstring string, signature string, visibility string, is_exported int, is_async int, is_static int, is_abstract int, decorators string, type_parameters string, updated_at long"
EDGES = "id long, source string, target string, kind string, metadata string, line int, col int, provenance string, recorded_at timestamp"
FILES = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors string"
REFS = "id long, source string, file_path string, callee_name string, line int, col int"


def node(id_, name="f", kind="function", path="r/a.ts", line=1, end=None, updated=1, exported=0, doc=None, qualified=None, language="typescript", signature=None):
    return (id_, kind, name, qualified or f"{path}::{name}", path, language, line, end or line + 2, 0, 1, doc, signature, None, exported, 0, 0, 0, "[]", None, updated)


def edge(id_, source, target, kind="calls", line=None, col=None, at=None):
    return (id_, source, target, kind, None, line, col, "lexer", at)


@pytest.fixture
def make(spark):
    schemas = {"nodes": NODES, "edges": EDGES, "files": FILES, "refs": REFS, "texts": "path string, text string", "documents": "doc_id long, text string, source string, lang string"}
    return lambda kind, rows: spark.createDataFrame(rows, schemas[kind])
