"""One exception for all failures, with the status codes and categories that scripts may rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

# Status codes and the category of each.
CATEGORY = {
    "OK": "NINGUNA",
    "ARGUMENT": "EJECUCION",
    "MEMORY": "MEMORIA",
    "IO": "NINGUNA",
    "PARSE": "SINTAXIS",
    "DATA": "DATOS",
    "TYPE": "TIPO",
    "OVERFLOW": "NINGUNA",
    "UNSUPPORTED": "NINGUNA",
    "INTERNAL": "EJECUCION",
    "LIMIT": "DATOS",
}


class EngineError(Exception):
    def __init__(self, code: str, message: str, line: int = 0, column: int = 0, row: int = 0):
        super().__init__(f"{code}: {message}" + (f" (line {line}, column {column})" if line else ""))
        self.code, self.message, self.line, self.column, self.row = code, message, line, column, row

    @property
    def category(self) -> str:
        return CATEGORY.get(self.code, "NINGUNA")


@contextmanager
def translated() -> Iterator[None]:
    """Spark's own errors as EngineError."""
    from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, ParseException, PySparkException

    try:
        yield
    except EngineError:
        raise
    except ParseException as e:
        raise EngineError("PARSE", str(e)) from e
    except AnalysisException as e:
        raise EngineError("TYPE" if "DATATYPE_MISMATCH" in str(e) else "DATA", str(e)) from e
    except ArithmeticException as e:
        raise EngineError("ARGUMENT" if "DIVIDE_BY_ZERO" in str(e) else "OVERFLOW", str(e)) from e
    except NumberFormatException as e:
        raise EngineError("TYPE", str(e)) from e
    except PySparkException as e:
        raise EngineError("INTERNAL", str(e)) from e
