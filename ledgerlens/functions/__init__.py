from ledgerlens.functions import values  # noqa: F401
