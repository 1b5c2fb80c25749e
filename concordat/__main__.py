import sys

from concordat.plans.commands import main

sys.exit(main())
