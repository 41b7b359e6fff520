import sys

from rulesieve.cli import main

sys.exit(main())
