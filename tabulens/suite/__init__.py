"""Every operator as a query over the given tables, with the equivalent SQL where there is one."""

from tabulens.suite import aggregates, charts, choices, classes, cleaning, files, hard, outlier, profiling, statistics, text

MODULES = [statistics, profiling, classes, choices, aggregates, outlier, cleaning, charts, text, files, hard]


def queries():
    return {name: run for module in MODULES for name, (run, _sql) in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, (_run, sql) in module.QUERIES.items() if sql}
