"""Small graphs whose results are known."""

from __future__ import annotations

from cairngraph.graph import CodeGraph


def _unit(id_, kind, name, qname, file, lines, lang="Rust", **more):
    a, b = lines
    return {"id": id_, "unit_type": kind, "language": lang, "name": name, "qualified_name": qname, "file_path": file, "start_line": a, "end_line": b} | more


def rich(spark) -> CodeGraph:
    """Fourteen units of two languages with all kinds of edges that the queries read."""
    app, auth = "src/app.rs", "src/auth.py"
    units = [
        _unit(0, "module", "app", "app", app, (1, 200)),
        _unit(1, "function", "process_payment", "app::process_payment", app, (10, 40), visibility="public", complexity=8, change_count=12, stability_score=0.3, doc_summary="Process a payment transaction."),
        _unit(2, "function", "validate_input", "app::validate_input", app, (50, 70), visibility="private", complexity=3, change_count=2, stability_score=0.9),
        _unit(3, "function", "send_notification", "app::send_notification", app, (80, 100), visibility="public", complexity=5),
        _unit(4, "type", "PaymentConfig", "app::PaymentConfig", app, (110, 130)),
        _unit(5, "test", "test_process_payment", "app::test_process_payment", app, (140, 160)),
        _unit(6, "trait", "Validator", "app::Validator", app, (170, 190)),
        _unit(7, "type", "UserValidator", "app::UserValidator", app, (200, 220)),
        _unit(8, "type", "InputValidator", "app::InputValidator", app, (230, 250)),
        _unit(9, "module", "auth", "auth", auth, (1, 100), "Python"),
        _unit(10, "function", "login", "auth::login", auth, (10, 30), "Python", complexity=6, change_count=8, stability_score=0.5, doc_summary="Authenticate user with credentials."),
        _unit(11, "function", "logout", "auth::logout", auth, (40, 55), "Python"),
        _unit(12, "function", "helper_internal", "app::helper_internal", app, (260, 280), visibility="private", complexity=15, change_count=20, stability_score=0.1),
        _unit(13, "test", "test_login", "auth::test_login", "tests/test_auth.py", (1, 20), "Python"),
    ]
    edges = [(0, i, "contains") for i in (1, 2, 3, 4, 5, 6, 7, 8, 12)] + [(9, 10, "contains"), (9, 11, "contains")]
    edges += [(1, 2, "calls", 1.0, 20), (1, 3, "calls", 1.0, 30), (10, 1, "calls", 1.0, 15), (1, 4, "uses_type"), (5, 1, "tests"), (13, 10, "tests"), (7, 6, "implements"), (8, 6, "inherits"), (1, 3, "couples_with", 0.8)]
    return CodeGraph.of_rows(spark, units, edges)


def cycle(spark, n: int = 3) -> CodeGraph:
    units = [_unit(i, "function", f"f{i}", f"cycle::f{i}", "src/c.rs", (1, 5)) for i in range(n)]
    return CodeGraph.of_rows(spark, units, [(i, (i + 1) % n, "calls") for i in range(n)])


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def ids(df, column: str = "id"):
    return [r[column] for r in df.collect()]
