from castellan.cli import main

raise SystemExit(main())
