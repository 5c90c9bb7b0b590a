"""``python -m parallax score|train ...``: the timed jobs of ``plans.jobs``."""

import sys

from parallax.plans.jobs import main

if __name__ == "__main__":
    main(sys.argv[1:])
