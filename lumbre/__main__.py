"""python -m lumbre analizar|perfil|run|inspect ..."""

from __future__ import annotations

import json
import logging
import sys
import time

from lumbre.errors import EngineError
from lumbre.plans.runner import run_file
from lumbre.session import session
from lumbre.sources import csv, reports
from lumbre.types import Schema

USAGE = """analizar FILE DATE PRICE QUANTITY OUT   sales summary
perfil FILE OUT                          profile of all columns as text
inspect FILE                             the first rows
run SCRIPT                               a script"""


def main(args: list[str]) -> int:
    log = logging.getLogger("lumbre")
    started = time.monotonic()
    try:
        verb = args[0] if args else ""
        spark = session(master=None)
        if verb == "run" and len(args) == 2:
            out = run_file(spark, args[1])
            for name, value in [*out.statistics, *out.values.items()]:
                print(f"{name} = {value}")
            for df in out.sql:
                print(reports.show(df, 100))
        elif verb == "analizar" and len(args) == 6:
            _, path, _date, price, quantity, target = args
            doc = reports.rows_of(reports.sales_summary(csv.load_csv(spark, path).rows, price, quantity))[0]
            reports.publish({"analisis": "ventas", **doc}, target)
        elif verb == "perfil" and len(args) == 3:
            table = csv.load_csv(spark, args[1])
            reports.publish(reports.dataset_profile(table.rows, "perfil", Schema({c: "texto" for c in table.rows.columns}), table.invalid_rows()), args[2])
        elif verb == "inspect" and len(args) == 2:
            print(reports.show(csv.load_csv(spark, args[1]).rows, 5))
        else:
            print(USAGE, file=sys.stderr)
            return 2
    except EngineError as e:
        print(json.dumps({"error": e.code, "categoria": e.category, "mensaje": e.message, "linea": e.line, "columna": e.column}, ensure_ascii=False), file=sys.stderr)
        return 1
    log.info(json.dumps({"verb": args[0], "ms": int(1000 * (time.monotonic() - started))}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
