"""Whole jobs over charts and the queries registered for the driver."""


def load_registered() -> None:
    import importlib
    import pkgutil

    from chartloom.plans import registered

    for m in pkgutil.iter_modules(registered.__path__):
        importlib.import_module(f"chartloom.plans.registered.{m.name}")
