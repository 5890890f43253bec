from tickvault.cli import main

raise SystemExit(main())
