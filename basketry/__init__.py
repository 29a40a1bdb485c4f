"""basketry: next-basket ranking over transaction ledgers, written for Spark."""

from basketry.config import CARDS, ORDERS, LedgerSpec

__all__ = ["CARDS", "ORDERS", "LedgerSpec"]
