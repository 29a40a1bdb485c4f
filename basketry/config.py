"""What a ledger looks like: periods, items, roles of its columns.

Every operator works on a long ledger with the key columns ``chid`` (client), ``dt`` (period, 1..n_periods) and
``tag`` (item).  A :class:`LedgerSpec` carries the few facts an operator needs beyond the columns themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

KEY = ("dt", "chid", "tag")

# Fixed values the results depend on.
NEVER = 100  # gap of an item that was never bought
OLD_GAP_DEFAULT = 24.0  # default of the older gap vector
PSEUDO_ZERO = 797.165663  # amount that stands for an empty cell
PSEUDO_ZERO_PER_COUNT = 1025.89962  # the same for amount-per-count states
TOP_N = 3

ItemSet = str | Sequence[int]


@dataclass(frozen=True)
class LedgerSpec:
    """Roles and bounds of one ledger.

    ``items`` is the closed item dictionary; everything that is packed per client (item vectors, per-client maps) is
    bounded by its length.  ``max_codes`` bounds the number of codes of one client attribute.
    """

    n_periods: int
    items: tuple[int, ...]
    legit: tuple[int, ...]
    amount: str
    count: str = "txn_cnt"
    channels: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    limit: str = "slam"
    horizon: int = 1
    max_codes: int = 256
    pseudo_zero: float = PSEUDO_ZERO
    label_map: dict[int, int] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        if self.n_periods < 1:
            raise ValueError("a ledger has at least one period")
        if not set(self.legit) <= set(self.items):
            raise ValueError("legit items must be items")
        object.__setattr__(self, "label_map", {tag: i for i, tag in enumerate(self.legit)})

    def item_set(self, which: ItemSet) -> tuple[int, ...]:
        """``leg``, ``illeg``, ``all`` or an explicit list of items."""
        if isinstance(which, str):
            if which == "leg":
                return self.legit
            if which == "illeg":
                return tuple(i for i in self.items if i not in set(self.legit))
            if which == "all":
                return self.items
            raise ValueError(f"unknown item set {which!r}: use leg, illeg, all or a list")
        if isinstance(which, (bool, int)):
            raise ValueError("an item set is leg, illeg, all or a list of items")
        unknown = set(which) - set(self.items)
        if unknown:
            raise ValueError(f"not in the item dictionary: {sorted(unknown)}")
        return tuple(which)


ORDERS = LedgerSpec(
    n_periods=27,
    items=tuple(range(1, 26)),
    legit=(2, 3, 5, 7, 11, 13, 17, 19),
    amount="amt_cents",
    channels=("a", "n", "r"),
    attributes=("nation", "segment", "region", "prio"),
    limit="lim_cents",
)

CARDS = LedgerSpec(
    n_periods=24,
    items=tuple(range(1, 50)),
    # The items a ranking may contain.
    legit=(2, 6, 10, 12, 13, 15, 18, 19, 21, 22, 25, 26, 36, 37, 39, 48),
    amount="txn_amt",
    channels=("domestic_offline", "domestic_online", "overseas_offline", "overseas_online"),
    # The client attributes of a card ledger.
    attributes=("masts", "educd", "trdtp", "naty", "poscd", "cuorg", "gender_code", "age"),
)


@dataclass(frozen=True)
class Decay:
    """Parameters of one time-decayed vector: window, group size, decay across and within groups."""

    window: int = 12
    gp_size: int = 3
    decay_g: float = 0.5
    decay_b: float = 0.9
    inclusive: bool = False

    def periods(self, t_end: int) -> tuple[int, int]:
        """First and last period used; a window of w covers w - 1 periods unless ``inclusive``."""
        first = t_end - self.window + (1 if self.inclusive else 2)
        n = t_end - first + 1
        if first < 1:
            raise ValueError(f"window {self.window} reaches before period 1 at t_end {t_end}")
        if n < self.gp_size:
            raise ValueError(f"window {self.window} is shorter than one group of {self.gp_size}")
        return first, t_end

    def weights(self, t_end: int) -> list[float]:
        """Weight by age: entry a is the weight of period t_end - a."""
        first, last = self.periods(t_end)
        return [
            self.decay_g ** (age // self.gp_size) * self.decay_b ** (age % self.gp_size)
            for age in range(last - first + 1)
        ]


def trailing(t_end: int, lo: int, up: int = 0) -> tuple[int, int]:
    """Periods ``[t_end - lo + 1, t_end - up]`` of the trailing window ``(lo, up)``; rejects periods before 1."""
    first, last = t_end - lo + 1, t_end - up
    if first < 1:
        raise ValueError(f"window ({lo}, {up}) reaches before period 1 at t_end {t_end}")
    if last < first:
        raise ValueError(f"window ({lo}, {up}) is empty")
    return first, last
