"""OWASP Top Ten 2021 categories of weakness ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weaknesses of each category, as published for the Top Ten of 2021 (fixed values).
CATEGORIES = {
    1: "22 23 35 59 200 201 219 264 275 276 284 285 352 359 377 402 425 441 497 538 540 548 552 566 601 639 651 668 706 862 863 913 922 1275",
    2: "261 296 310 319 321 322 323 324 325 326 327 328 329 330 331 335 336 337 338 340 347 523 720 757 759 760 780 818 916",
    3: "20 74 75 77 78 79 80 83 87 88 89 90 91 93 94 95 96 97 98 99 113 116 138 184 470 471 564 610 643 644 652 917",
    4: "73 183 209 213 235 256 257 266 269 280 311 312 313 316 419 430 434 444 451 472 501 522 525 539 579 598 602 642 646 650 653 656 657 799 807 840 841 927 1021 1173",
    5: "2 11 13 15 16 260 315 520 526 537 541 547 611 614 756 776 942 1004 1032 1174",
    6: "937 1035 1104",
    7: "255 259 287 288 290 294 295 297 300 302 304 306 307 346 384 521 613 620 640 798 940 1216",
    8: "345 353 426 494 502 565 784 829 830 915",
    9: "117 223 532 778",
    10: "918",
}


def category_of() -> dict[str, int]:
    return {f"CWE-{n}": category for category, ids in CATEGORIES.items() for n in ids.split()}


def owasp_of(cwes: Column) -> Column:
    """Sorted distinct categories of a set of weaknesses; ``[0]`` (unknown) if none is listed."""
    table = F.create_map(*(F.lit(x) for kv in category_of().items() for x in kv))
    known = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(cwes, F.array().cast("array<string>")), lambda c: table[c]), lambda n: n.isNotNull())))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(0)))
