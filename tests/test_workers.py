"""Workers find the package although the driver was started elsewhere."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_ngram_search_from_another_folder(tmp_path):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from normlens.operators import folds, ngram_ridge
        from normlens.session import local_session
        from normlens.spec import NormSpec
        spark = local_session(2)
        rows = [(f"word{{i}}{{'ab' * (i % 4)}}", float(i % 7)) for i in range(60)]
        words = folds.assign_folds(spark.createDataFrame(rows, "w string, y double"), ["w"])
        print("FOLDS", ngram_ridge.ngram_cv(words, "w", "w", ["y"], NormSpec(ridge_alphas=(1.0,), min_df=1)).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "FOLDS 5" in done.stdout, done.stderr[-2000:]
