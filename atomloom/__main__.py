import sys

from atomloom.plans.programs import main

sys.exit(main(sys.argv[1:]))
