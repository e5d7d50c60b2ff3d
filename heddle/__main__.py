"""A shell: statements from the terminal or a pipe, each ended by a semicolon. ``python -m heddle [folder]``."""

from __future__ import annotations

import sys
import time

from pyspark.errors import PySparkException

from heddle.engine import Engine
from heddle.errors import EngineError
from heddle.plans import statements as S
from heddle.session import session


def run(engine: Engine, text: str, out=sys.stdout) -> None:
    """Run statements, print each one's rows or what is wrong with it."""
    for statement in S.split(text):
        began = time.time()
        try:
            engine.sql(S.text(statement)).show(1000, truncate=False)
            print(f"{time.time() - began:.2f} s", file=out)
        except EngineError as e:
            print(f"error {e.code}: {e}" + (f" ({e.advice})" if e.advice else ""), file=out)
        except PySparkException as e:
            print(f"error: {e.getCondition() or ''} {str(e).splitlines()[0]}", file=out)


def main() -> None:
    spark = session("local[*]", spark__ui__showConsoleProgress="false", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    engine = Engine(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    held = ""
    for line in sys.stdin:
        if line.strip().lower() in (r"\q", "quit", "exit"):
            break
        held += line
        if held.rstrip().endswith(";"):
            run(engine, held)
            held = ""
    if held.strip():
        run(engine, held)


if __name__ == "__main__":
    main()
