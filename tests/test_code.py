import pytest
from pyspark.sql import functions as F

from notespark.operators import code, packing

FILES = [
    ("package.json", '{"dependencies": {"next": "1", "@prisma/client": "1"}}'), ("tsconfig.json", "{}"),
    ("README.md", "read me"), ("src/index.ts", "import { a } from './utils'\nconst b = require('lodash/fp')\n"),
    ("src/utils.ts", "export const a = 1"), ("image.png", "x"), ("node_modules/thing.js", "import 'x'"),
    ("api/user_service.py", "import os.path\nfrom pkg.models import User\nfrom . import x\n"),
    ("api/models.py", "class User(db.Model):\n    pass\n\nclass Note(Base):\n    pass\n"),
    ("api/broken.py", "def ("), ("lib/a.dart", "import 'package:flutter/x.dart';\nimport 'dart:io';\nimport 'b/c.dart';\n"),
    ("app/api/item/[id]/route.ts", "export async function GET() {}\nexport function POST() {}"),
    ("app/page.tsx", "stripe twilio"), ("app/shop/[id]/page.tsx", "x"), ("templates/home.html", "x"),
    ("api/routes.py", "@app.get('/a')\ndef a(): pass\n@bp.route(\"/b\")\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("demo", p, c) for p, c in FILES], "project string, path string, raw_content string")


@pytest.mark.parametrize("path, want", [
    ("src/Routes/user.ts", "api"), ("src/user_service.py", "service"), ("db/seed.sql", "data"),
    ("tests/x.py", "test"), ("widget.dart", "ui"), ("main.rs", "other")])
def test_layer(value, path, want):
    assert value(code.layer(F.lit(path))) == want


def test_modules(files):
    found = {r.path: r for r in code.modules(files).collect()}
    assert "node_modules/thing.js" not in found and "image.png" not in found
    assert found["api/user_service.py"].imports == ["os", "path", "pkg", "models"]
    assert found["api/broken.py"].imports == []
    assert found["src/index.ts"].imports == ["utils", "lodash"] and found["src/index.ts"].size_lines == 2
    assert found["lib/a.dart"].imports == ["flutter", "b"]
    edges = {(r.source, r.target) for r in code.edges(code.modules(files)).collect()}
    assert edges == {("src/index.ts", "src/utils.ts"), ("api/user_service.py", "api/models.py")}
    assert {r.name for r in code.external(code.modules(files)).collect()} == {"os", "path", "pkg", "lodash", "flutter", "b"}


def test_file_limit(files):
    assert code.source_files(files, 2).count() == 2


def test_detectors(files):
    assert {r.tech for r in code.stacks(files).collect()} == {"Node.js", "TypeScript", "Next.js", "Prisma"}
    assert {(r.route, r.method) for r in code.routes(files).collect()} == {
        ("/a", "GET"), ("/b", "ROUTE"), ("/api/item/:id", "GET"), ("/api/item/:id", "POST")}
    assert {r.page for r in code.pages(files).collect()} == {"/", "/shop/:id", "/home"}
    assert {(r.db_type, r.model) for r in code.databases(files).collect()} == {("SQLAlchemy", "User"), ("SQLAlchemy", "Note")}
    assert {r.service for r in code.services(files).collect()} == {"Stripe", "Twilio"}


def test_priorities(value):
    got = {p: value(packing.priority(F.lit(p))) for p in ["package.json", "src/x.test.ts", "src/api.ts", "readme.txt"]}
    assert got == {"package.json": "high", "src/x.test.ts": "low", "src/api.ts": "medium", "readme.txt": "medium"}


def test_shortened(value):
    text = "\n".join(str(i) for i in range(100))
    lines = value(packing.shortened(F.lit(text), 10)).split("\n")
    assert lines[:6] == list("012345") and lines[-4:] == ["96", "97", "98", "99"]
    assert "... [90 lines omitted] ..." in lines
    assert value(packing.shortened(F.lit("a\nb"), 10)) == "a\nb"


def test_budget_takes_files_while_below(spark):
    rows = [("p", f"src/{i}.txt", "x" * 4 * n) for i, n in enumerate([5, 6, 7])]
    df = spark.createDataFrame(rows, "project string, path string, raw_content string")
    got = {r.path: r.tokens_before for r in packing.pack(df, "full", 10).collect()}
    assert got == {"src/0.txt": 0, "src/1.txt": 5}


def test_pack(files):
    packed = packing.pack(files, "compact")
    paths = [r.path for r in packed.collect()]
    assert "image.png" not in paths and "node_modules/thing.js" not in paths
    row = packing.pack_summary(packed, files).first()
    assert row.included_files == len(paths) == row.total_files
    minimal = packing.pack(files, "minimal")
    assert minimal.where("priority = 'low'").count() == 0


def test_tree_and_schema(spark, files):
    lines = {r.line for r in packing.tree(files).where("directory IN ('', 'src')").collect()}
    assert {"README.md", "src/ (2 files)", "index.ts", "utils.ts"} <= lines
    assert packing.database_schema(files).first().path == "api/models.py"
    both = files.unionByName(spark.createDataFrame([("demo", "prisma/schema.prisma", 'provider = "sqlite"\nmodel User {\n}\n')], files.schema))
    assert packing.database_schema(both).first().path == "prisma/schema.prisma"
    assert {(r.db_type, r.model) for r in code.databases(both).collect()} == {("Prisma + SQLite", "User")}
