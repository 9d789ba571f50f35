import pytest

from plumbline.functions import python_ast
from plumbline.operators import graph, imports


@pytest.mark.parametrize(
    ("source", "cyclomatic", "nesting"),
    [
        ("def f(a, b):\n    if a and b:\n        pass\n    elif a:\n        pass\n    for x in a:\n        pass\n    try:\n        pass\n    except E:\n        pass\n", 6, 1),
        ("def f(a):\n    return [x for x in a if x]\n", 3, 0),
        ("def f(a):\n    match a:\n        case 1:\n            pass\n        case _:\n            pass\n", 2, 1),
        ("def f(a):\n    while a:\n        if a:\n            pass\n", 3, 2),
    ],
)
def test_callables(source, cyclomatic, nesting):
    (x,) = python_ast.callables(source)
    assert (x["cyclomatic"], x["max_nesting"]) == (cyclomatic, nesting) and python_ast.file_cyclomatic(source) == cyclomatic


def test_keys_and_outline():
    source = "class A:\n    def f(self,\n          x): return self.f(x)\n    def f(self): pass\n\ndef _g(): return _g()\nif True:\n    pass\n"
    some = python_ast.callables(source)
    assert [x["symbol_key"] for x in some] == ["A.f", "A.f#2", "_g"] and some[2]["cognitive"] == 1
    assert python_ast.file_cyclomatic(source) == 4
    assert [(x["name"], x["kind"], x["exported"]) for x in python_ast.outline(source)] == [("A", "class", True), ("A.f", "method", True), ("A.f", "method", True), ("_g", "function", False)]
    assert [x["signature"] for x in python_ast.outline(source)] == ["class A", "def f(self, x)", "def f(self)", "def _g()"]


FILES = {
    "pkg/__init__.py": ("Python", ""),
    "pkg/a.py": ("Python", "from . import b\nfrom .sub.c import x\nimport os\nimport pkg.b"),
    "pkg/b.py": ("Python", "from pkg import a"),
    "pkg/sub/c.py": ("Python", "def ("),
    "web/app.ts": ("TypeScript", "import x from './lib/x'\nimport { y } from \"./y.js\"\nexport * from './z'\nimport React from 'react'\nconst q = require('../out')"),
    "web/lib/x.tsx": ("TSX", ""),
    "web/y.ts": ("TypeScript", ""),
    "web/z/index.js": ("JavaScript", ""),
    "src/main.rs": ("Rust", "mod a;\nuse crate::a::b::Thing;\n"),
    "src/a.rs": ("Rust", "pub mod b;\nuse super::main;"),
    "src/a/b.rs": ("Rust", "use super::helper;"),
    "go.x/m/util/u.go": ("Go", "package util"),
    "go.x/m/main.go": ("Go", 'package main\nimport (\n  "fmt"\n  u "example.org/go.x/m/util"\n)'),
    "src/App/K.php": ("PHP", "<?php\nuse App\\L;\nrequire_once __DIR__ . '/inc.php';"),
    "src/App/L.php": ("PHP", ""),
    "src/App/inc.php": ("PHP", ""),
}


def test_import_edges(spark):
    files = spark.createDataFrame([(p, *v) for p, v in FILES.items()], "path string, language string, content string")
    got = {(r.source, r.target) for r in imports.edges(files).collect()}
    assert got == {
        ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/sub/c.py"), ("pkg/b.py", "pkg/a.py"),
        ("web/app.ts", "web/lib/x.tsx"), ("web/app.ts", "web/y.ts"), ("web/app.ts", "web/z/index.js"),
        ("src/main.rs", "src/a.rs"), ("src/main.rs", "src/a/b.rs"), ("src/a.rs", "src/a/b.rs"), ("src/a.rs", "src/main.rs"),
        ("go.x/m/main.go", "go.x/m/util/u.go"), ("src/App/K.php", "src/App/L.php"), ("src/App/K.php", "src/App/inc.php"),
    }
    missing = {r.specifier for r in imports.resolved(files).where("target is null").collect()}
    assert missing == {"os", "react", "../out", "fmt", "super::helper"}
    cycles = {r.members for r in graph.cycles(imports.edges(files)).collect()}
    assert "pkg/a.py,pkg/b.py" in cycles
    assert {r.symbol_key for r in python_ast.functions(files).collect()} == set()
