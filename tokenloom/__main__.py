import sys

from tokenloom.cli import main

sys.exit(main())
