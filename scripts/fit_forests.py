"""Fit the forests that come with the library and write them below rentscope/models.

    python scripts/fit_forests.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv: list[str]) -> int:
    from rentscope.operators import churn
    from rentscope.registry import CHURN_AS_OF, NO_RECENCY
    from rentscope.session import local_session
    from rentscope.sources import driver

    spark = local_session()
    features = churn.churn_features(driver.load(spark, argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"), as_of=CHURN_AS_OF)
    os.makedirs(f"{ROOT}/rentscope/models", exist_ok=True)
    for name, columns in (("churn", churn.FEATURES), ("churn_no_recency", NO_RECENCY)):
        forest = churn.fit_churn_forest(features, columns)
        with open(f"{ROOT}/rentscope/models/{name}.json", "w", encoding="utf-8") as f:
            f.write(forest.rounded().to_json())
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
